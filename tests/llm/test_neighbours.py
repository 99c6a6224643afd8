from __future__ import annotations

import numpy as np
import pytest

from lexarium.llm import neighbours


def brute(ids, rows, k):
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {int(ids[i]): [(int(ids[j]), round(float(d[i, j]), 6)) for j in np.lexsort((ids, d[i].round(6)))[:k]] for i in range(len(ids))}


def table(spark, ids, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in r], 0, 1) for i, r in zip(ids, rows)], "vec_id bigint, embedding array<float>, shard int, v int")


def vectors(n, dims, seed):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, dims)) + 3 * r.normal(size=(8, dims))[r.integers(0, 8, n)]).astype(np.float32)


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["vec_id"], []).append((r["neighbour_id"], r["distance"]))
    return out


@pytest.mark.parametrize("query_rows", [100, 10_000])
def test_exact(spark, query_rows):
    rows = vectors(900, 6, 1)
    rows[10:14] = rows[9]
    ids = np.arange(900) * 7
    got = collected(neighbours.nearest(table(spark, ids, rows), 5, factor=1.0, shard_rows=150, query_rows=query_rows))
    want = brute(ids, rows.astype(float), 5)
    assert set(got) == set(want) and all([d for _, d in got[k]] == pytest.approx([d for _, d in want[k]], abs=2e-6) for k in want)
    assert np.mean([len({a for a, _ in got[k]} & {a for a, _ in want[k]}) / 5 for k in want]) > 0.995  # ties beyond the last place


def test_ties_and_hot_shards(spark):
    """A third of the rows is one vector: its shard is dealt to parts, and ties go by id."""
    rows = vectors(600, 5, 4)
    rows[np.arange(600) % 3 == 1] = rows[1]
    ids = np.arange(600) * 5 + 1
    got = collected(neighbours.nearest(table(spark, ids, rows), 7, shard_rows=40, query_rows=50, max_pivots=4))
    assert got == brute(ids, rows.astype(float), 7)


def test_queries_by_id(spark):
    rows = vectors(400, 16, 6)
    got = collected(neighbours.nearest(table(spark, np.arange(400) - 40, rows), shard_rows=100, every=20))
    want = {i: n for i, n in brute(np.arange(400) - 40, rows.astype(float), 10).items() if i % 20 == 0}
    assert len(want) == 20 and got == want


def test_larger_factors_find_less(spark):
    rows = vectors(1500, 6, 8)
    want = brute(np.arange(1500), rows.astype(float), 10)
    recalls = []
    for factor in (1.0, 1.3, 4.0):
        got = collected(neighbours.nearest(table(spark, np.arange(1500), rows), factor=factor, shard_rows=200))
        recalls.append(np.mean([len({a for a, _ in got[k]} & {a for a, _ in want[k]}) / 10 for k in want]))
    assert recalls[0] == 1 and recalls[0] >= recalls[1] >= recalls[2] and recalls[1] >= 0.9


def test_recall_as_in_production(spark):
    rows = np.random.default_rng(2).normal(size=(1500, 64)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    got = collected(neighbours.nearest(table(spark, np.arange(1500), rows), shard_rows=500))
    want = brute(np.arange(1500), rows.astype(float), 10)
    assert len(got) == 1500 and np.mean([len({a for a, _ in got[k]} & {a for a, _ in want[k]}) / 10 for k in want]) >= 0.9


@pytest.mark.parametrize("kind", ["clustered", "gaussian", "low rank", "low rank on the sphere"])
def test_recall_of_few_dimensions_as_in_production(spark, kind):
    r = np.random.default_rng(3)
    rows = {
        "clustered": lambda: vectors(1500, 6, 3),
        "gaussian": lambda: r.normal(size=(1500, 16)),
        "low rank": lambda: r.normal(size=(1500, 8)) @ r.normal(size=(8, 64)),
        "low rank on the sphere": lambda: r.normal(size=(1500, 12)) @ r.normal(size=(12, 64)),
    }[kind]()
    if kind.endswith("sphere"):
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows.astype(np.float32)
    got = collected(neighbours.nearest(table(spark, np.arange(1500), rows), shard_rows=500))
    want = brute(np.arange(1500), rows.astype(float), 10)
    recall = np.mean([len({a for a, _ in got[k]} & {a for a, _ in want[k]}) / 10 for k in want])
    assert len(got) == 1500 and recall >= 0.99


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [5.0, 5.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (None, [0.0, 0.0]), (6, [float("inf"), 0.0]), (7, []), (8, [0.0, None])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(df).orderBy("vec_id").collect()] == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    assert neighbours.nearest(df.filter("vec_id = 1")).isEmpty() and neighbours.nearest(df.limit(0)).isEmpty()
    assert neighbours.nearest(df.filter("vec_id = 3")).isEmpty()
    same = table(spark, range(300), np.ones((300, 3)))
    assert neighbours.nearest(same, 4).filter("distance = 0").count() == 1200
