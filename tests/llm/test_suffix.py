from __future__ import annotations

import pytest

from lexarium.llm import parts, suffix

from .helpers import ODD, documents, prose


def brute(texts, window=50):
    """Spans by plain loops: all windows but the first of each, joined where they meet."""
    first, out = {}, []
    for i, t in enumerate(texts):
        w = (t or "").split()
        spans = []
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in first:
                if spans and p <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], p + window, min(spans[-1][2], first[key]))
                else:
                    spans.append((p, p + window, first[key]))
            else:
                first[key] = i
        out += [(i, *s) for s in spans]
    return sorted(out)


def corpus():
    passage, other = prose(1, 70), prose(2, 55)
    return [
        *ODD[:4], ODD[4], "ünïcödé 你好 🌟 " + prose(9, 60),
        prose(10, 100) + " " + passage + " " + prose(11, 20),
        passage, prose(12, 30) + "\n" + passage + "\n" + other, other + " " + prose(13, 40) + " " + other,
        prose(14, 49), prose(14, 49), prose(15, 50), prose(15, 50), "word " * 200, "a b " * 80,
        *(prose(16, 90) for _ in range(12)),
    ]


@pytest.mark.parametrize(("depths", "block"), [(suffix.DEPTHS, suffix.BLOCK_BYTES), ((50,), 1), ((3, 7, 30), 2000)])
def test_against_brute_force(spark, depths, block, monkeypatch):
    monkeypatch.setattr(suffix, "KEYS_A_BUCKET", 1)  # so that blocks are as small as asked
    texts = corpus()
    got = suffix.repeated_spans(documents(spark, texts, extra=True), depths=depths, block_bytes=block)
    assert sorted((r["doc_id"], r["start"], r["end"], r["of_doc_id"]) for r in got.collect()) == brute(texts)


def test_drop(spark):
    texts = corpus()
    docs = documents(spark, texts, extra=True)
    kept = suffix.drop_spans(docs)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r for r in kept.collect()}
    spans = {}
    for i, s, e, _ in brute(texts):
        spans.setdefault(i, []).append((s, e))
    for i, t in enumerate(texts):
        if i not in spans:
            assert got[i]["text"] == t
            continue
        words = [w for p, w in enumerate(t.split()) if not any(s <= p < e for s, e in spans[i])]
        assert (got[i]["text"].split() if words else got.get(i)) == (words or None)
        assert not words or got[i]["n_chars"] == len(got[i]["text"])


def test_small(spark):
    assert suffix.repeated_spans(documents(spark, [])).isEmpty() and suffix.drop_spans(documents(spark, [])).isEmpty()
    t = prose(3, 60)
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None)], "doc_id bigint, text string")
    assert suffix.repeated_spans(docs).isEmpty() and suffix.drop_spans(docs).count() == 4


def test_hot_copies_and_partitions(spark, tmp_path):
    """A third of all documents is one text; read from several files, in blocks of few documents."""
    hot = prose(20, 120)
    texts = [hot if i % 3 == 0 else prose(1000 + i, 80) + (" " + hot if i % 10 == 1 else "") for i in range(90)]
    documents(spark, texts, extra=True).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert parts.as_scan(docs, "x") is docs and parts.as_scan(docs.repartition(2), "x").count() == 90
    got = sorted((r["doc_id"], r["start"], r["end"], r["of_doc_id"]) for r in suffix.op8_suffix_array_dedup(spark, str(tmp_path)).collect())
    assert got == brute(texts)
    kept = {r["doc_id"]: r["text"] for r in suffix.drop_spans(docs).collect()}
    assert kept[0] == hot and not any(i in kept for i in range(3, 90, 3)) and hot not in kept[1] and kept[2] == texts[2]


def test_moved_partitions_start_over():
    tries = []

    def make():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError(f"a task failed: {parts.Moved()}")
        return "done"

    assert parts.settled(make) == "done" and len(tries) == 3
    with pytest.raises(ValueError):
        parts.settled(lambda: int("x"))
