from __future__ import annotations

import random
from collections import defaultdict

import pytest

from lexarium.llm import packing

from .helpers import ODD, documents, prose


def test_every_token_once(spark):
    texts = [prose(i, n) for i, n in enumerate([5, 70, 300, 33, 64, 1, 90, 12, 64, 7] * 6)] + ODD
    docs = documents(spark, texts, extra=True).repartition(7)
    rows = packing.pack(docs, capacity=64, fan_in=2).collect()
    covered, bins, fills = defaultdict(list), defaultdict(list), {}
    for r in rows:
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        bins[r["bin_id"]] += range(r["offset"], r["offset"] + r["length"])
        fills[r["bin_id"]] = r["fill"]
    sizes = {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert {i: sorted(c) for i, c in covered.items()} == {i: list(range(n)) for i, n in sizes.items() if n}
    assert all(sorted(b) == list(range(fills[k])) and fills[k] <= 64 for k, b in bins.items())
    assert len(bins) <= 1.1 * -(-sum(sizes.values()) // 64) + 1


def test_best_fit_by_hand():
    assert sorted(fill for fill, _ in packing.best_fit([(6, [(1, 0, 6, 0)]), (5, [(2, 0, 5, 0)]), (4, [(3, 0, 4, 0)]), (3, [(4, 0, 3, 0)])], 10)) == [8, 10]


@pytest.mark.parametrize("texts", [[], [None, ""], ["a b"]])
def test_small(spark, texts):
    rows = packing.pack(documents(spark, texts)).collect()
    assert [(r["doc_id"], r["length"]) for r in rows] == ([(0, 2)] if "a b" in texts else [])


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["length"]) for r in packing.pack(docs).collect()) == [(0, 1), (1, 2), (1, 2)]


def naive(items, capacity):
    """Best-fit decreasing by trying every bin: the fullest that has room, of equally full ones the one that became so last."""
    bins = []
    for clock, (size, doc) in enumerate(sorted(items, key=lambda x: -x[0])):
        fits = [b for b in bins if b["fill"] + size <= capacity]
        if fits:
            chosen = max(fits, key=lambda b: (b["fill"], b["clock"]))
        else:
            chosen = {"fill": 0, "docs": []}
            bins.append(chosen)
        chosen["fill"] += size
        chosen["docs"].append(doc)
        chosen["clock"] = clock
    return sorted((b["fill"], b["docs"]) for b in bins)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_against_every_bin(seed):
    r = random.Random(seed)
    items = [(r.randrange(1, 41), i) for i in range(r.randrange(1, 200))]
    got = packing.best_fit([(n, [(i, 0, n, 0)]) for n, i in items], 50)
    assert sorted((fill, [m[0] for m in members]) for fill, members in got) == naive(items, 50)


def test_one_partition_against_every_bin(spark):
    r = random.Random(3)
    sizes = [r.randrange(1, 60) for _ in range(150)]
    docs = documents(spark, [prose(i, n) for i, n in enumerate(sizes)]).coalesce(1)
    bins = defaultdict(list)
    for row in packing.pack(docs, capacity=64, nearly_full=1.0).collect():
        bins[row["bin_id"]].append((row["offset"], row["doc_id"], row["length"]))
    got = sorted(sum(n for *_, n in b) for b in bins.values())
    # the root packs what is not full again, which cannot need more bins
    want = [fill for fill, _ in naive([(n, i) for i, n in enumerate(sizes)], 64)]
    assert sum(got) == sum(sizes) and len(got) <= len(want) and got.count(64) >= want.count(64)
