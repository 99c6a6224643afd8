"""Every registered query of the lexicon engine against its SQL, over the smallest tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from lexarium.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(x):
    return round(float(x), 6) if isinstance(x, (float, Decimal)) else bytes(x) if isinstance(x, bytearray) else x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())
    else:
        assert got
