"""The registered queries against their SQL over the smallest tables, and the pipeline stage by stage."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

import corpus_pipeline
from lexarium.llm import registry

from .helpers import ODD, documents, edited, prose

DATA = "/root/testdata/sf0.001"


def plain(x):
    return round(float(x), 6) if isinstance(x, (float, Decimal)) else x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df, want = registry.QUERIES[name](spark, DATA), con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns) and rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_pipeline(spark, tmp_path):
    passage = prose(500, 60)
    clean = [prose(i, 80) for i in range(20)]
    rude = [prose(200 + i, 20) + (f" {prose(300 + i, 2)} idiot" * (i % 2)) for i in range(60)]
    texts = [*clean, "such an 1d10t " + prose(90, 30), clean[3], edited(clean[5], 1, 0.03), prose(91, 40) + " " + passage, prose(92, 40) + " " + passage, "\n".join([prose(93, 20), prose(94, 9), prose(93, 20)]), *ODD]
    docs = documents(spark, texts, extra=True).union(documents(spark, rude, extra=True, first=1000))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = current
        current = stage(spark, current, str(tmp_path))
        current.write.parquet(f"{tmp_path}/{name.split(' ')[0]}")
        current = spark.read.parquet(f"{tmp_path}/{name.split(' ')[0]}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert current.columns == before.columns
            seen[name] = {r["doc_id"]: r["text"] for r in current.collect()}
    assert set(seen["toxicity"]) == set(range(len(texts))) - {20} | set(range(1000, 1060, 2))
    assert 21 not in seen["line dedup"] and seen["line dedup"][25].count("\n") == 1
    assert 22 not in seen["n-gram Jaccard join"] and set(range(20)) <= set(seen["n-gram Jaccard join"])
    last = seen["suffix-array dedup"]
    assert passage in last[23] and passage not in last[24] and all(last[i] == clean[i] for i in range(20))
    packed = {}
    for r in current.collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == {i: len((t or "").split()) for i, t in last.items() if (t or "").split()}
    # bins depend on how the files are split, pieces do not
    pieces = lambda df: sorted((r["doc_id"], r["start"], r["length"]) for r in df.collect())
    assert pieces(current) == pieces(corpus_pipeline.run(spark, str(tmp_path)))
