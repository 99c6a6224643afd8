from __future__ import annotations

import random
from itertools import combinations

import pytest

import corpus_pipeline
from lexarium.llm import line_dedup

from .helpers import ODD, documents, prose


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tau(n):
    return 2 if n >= 80 else 1


def brute(texts):
    lines = [(i, k, x.encode()) for i, t in enumerate(texts) if t for k, x in enumerate(t.split("\n")) if len(x.encode()) >= 24]
    out = []
    for at, (i, k, x) in enumerate(lines):
        near = [(a, b) for a, b, y in lines[:at] if abs(len(x) - len(y)) <= 2 and (x == y or distance(x, y) <= tau(max(len(x), len(y))))]
        if near:
            out.append((i, k, *min(near)))
    return sorted(out)


def corpus():
    r = random.Random(4)
    lines = [prose(i, n) for i, n in enumerate((4, 5, 6, 12, 13, 14, 15, 20, 5, 14))]

    def change(x):
        for _ in range(r.randrange(4)):
            at = r.randrange(len(x))
            x = r.choice([x[:at] + x[at + 1 :], x[:at] + "é" + x[at:], x[:at] + "z" + x[at + 1 :]])
        return x

    return [*ODD, *("\n".join(change(r.choice(lines)) for _ in range(4)) + "\n" for _ in range(25)), "short\nshort"]


def test_against_brute_force(spark):
    texts = corpus()
    got = sorted(tuple(r) for r in line_dedup.duplicate_lines(documents(spark, texts, extra=True)).select("doc_id", "line_no", "of_doc_id", "of_line_no").collect())
    assert got == brute(texts)


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_segments(spark, hot):
    """With hardly any pair allowed a key, all go through the levels of more segments; none is lost."""
    r = random.Random(9)
    base = [prose(i, n) for i, n in enumerate((5, 14, 15, 30))]
    lines = [x for b in base for x in [b, *(b[:k] + r.choice(["", "q", "zz", "é"]) + b[k + r.randrange(2) :] for k in (r.randrange(len(b)) for _ in range(12)))]]
    lines = sorted({x for x in lines if len(x.encode()) >= 24})
    docs = documents(spark, ["\n".join(lines)])
    ids = {spark.sql("select xxhash64(:x) & ~1L", args={"x": x}).first()[0]: x.encode() for x in lines}
    got = {(r["a"], r["b"]): r["distance"] for r in line_dedup.near_lines(docs, hot_pairs=hot).collect()}
    want = {}
    for a, b in combinations(sorted(ids), 2):
        x, y = ids[a], ids[b]
        if (d := distance(x, y)) <= tau(max(len(x), len(y))):
            want[a, b] = d
    assert want and got == want


def test_distance():
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(9))).encode() for _ in range(60)]
    a, b = [x for x in words for _ in words], words * len(words)
    for t in (1, 2, 3):
        assert line_dedup.banded_distance(a, b, t).tolist() == [min(distance(x, y), t + 1) for x, y in zip(a, b)]


def test_drop(spark):
    texts = corpus()
    docs = documents(spark, texts, extra=True)
    gone = {(i, k) for i, k, _, _ in brute(texts)}
    kept = line_dedup.drop_lines(docs)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        left = "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone)
        if left.strip() or not any((i, k) in gone for k in range(len(lines))):
            assert got[i] == (t if t is None else left)
        else:
            assert i not in got


def test_short_lines_as_in_production(spark, tmp_path):
    edge = "twenty-three bytes line"
    texts = ["All rights reserved.\n\n  \nx\nyes", "All rights reserved.\n\n  \ny\nyex", edge + "\nx", edge + "!\nxy\n" + edge[:-1]]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in line_dedup.op10_line_dedup(spark, str(tmp_path)).select("doc_id", "line_no", "of_doc_id", "of_line_no").collect())
    assert len(edge) == 23 and got == [(1, 0, 0, 0), (2, 1, 0, 3), (3, 0, 2, 0)]
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert kept == {0: texts[0], 1: "\n  \ny\nyex", 2: edge, 3: "xy\n" + edge[:-1]}


def test_small(spark):
    assert line_dedup.duplicate_lines(documents(spark, [])).isEmpty()
    line = "a line of more than twenty-four bytes"
    docs = spark.createDataFrame([(1, line), (1, line), (None, line), (2, None), (3, line), (3, "other\n" + line)], "doc_id bigint, text string")
    assert sorted(tuple(r)[:2] for r in line_dedup.duplicate_lines(docs).select("doc_id", "line_no").collect()) == [(3, 0), (3, 1)]
    assert sorted(str(tuple(r)) for r in line_dedup.drop_lines(docs).collect()) == sorted(map(str, [(1, line), (1, line), (None, line), (2, None), (3, "other")]))
