from __future__ import annotations

import os
import random

import pytest

from lexarium.llm import pieces

from .helpers import ODD, documents, prose

MODEL = pieces.MODEL


def texts():
    r = random.Random(3)
    noise = ["".join(r.choice("ab ▁é\n\t.,'🌟你 ") for _ in range(r.randrange(40))) for _ in range(40)]
    return [*ODD, *noise, *(prose(i, 40) for i in range(10)), "  two  spaces ", "q" * 300 + " " + "ab" * 200, "\r\n"]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_same_codes_as_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = documents(spark, texts(), extra=True).repartition(3)
    for r in pieces.decode(pieces.encode(docs)).collect():
        assert r["codes"] == (None if r["text"] is None else processor.encode(r["text"]))
        assert r["decoded"] == (None if r["text"] is None else r["text"].replace("▁", " "))


def test_viterbi_for_unigram_models(spark):
    r = random.Random(5)
    vocab = {"▁": -3.0} | {c: -4.0 - i for i, c in enumerate("abcd")} | {"".join(r.choice("abcd") for _ in range(r.randrange(2, 5))): -r.uniform(2, 9) for _ in range(40)} | {"▁ab": -2.5}
    model = pieces.Model.of(list(vocab.items()), bpe=False)
    given = ["".join(r.choice("abcd z") for _ in range(r.randrange(1, 30))) for _ in range(60)] + [None, "", "a" * 100]

    def brute(text):
        best = {0: (0.0, [])}
        worst = min(vocab.values()) - 10
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - 4), e):
                p = text[s:e]
                if p in vocab or e - s == 1:
                    score = best[s][0] + vocab.get(p, worst)
                    if e not in best or score > best[e][0] + 1e-9:
                        best[e] = (score, [*best[s][1], p])
        return best[len(text)][0], [c for p in best[len(text)][1] for c in ([model.ids[p]] if p in vocab else model.fallback(p))]

    for row in pieces.encode(documents(spark, given), model).collect():
        if row["text"]:
            marked = ("▁" + row["text"]).replace(" ", "▁")
            score = sum(model.pieces[c][1] if c >= 259 else 0 for c in row["codes"])
            want, codes = brute(marked)
            assert len([c for c in row["codes"] if c < 259]) == len([c for c in codes if c < 259])
            assert abs(score - sum(model.pieces[c][1] if c >= 259 else 0 for c in codes)) < 1e-6
        else:
            assert row["codes"] == (None if row["text"] is None else [])
    for unit in ("abcdab", "aaaaazb", "▁ab"):
        assert abs(sum(model.pieces[c][1] for c in model.best_path(unit) if c >= 259) - sum(model.pieces[c][1] for c in brute(unit)[1] if c >= 259)) < 1e-6


def test_empty(spark):
    assert pieces.encode(documents(spark, [])).isEmpty()
    assert [r["codes"] for r in pieces.encode(documents(spark, [None, ""])).orderBy("doc_id").collect()] == [None, []]


def test_repeated_rows_and_codes_beyond_the_model(spark):
    model = pieces.Model.of([("▁a", -1.0), ("b", -2.0), ("a", -3.0), ("▁", -4.0)], bpe=True)
    docs = spark.createDataFrame([(1, "ab b"), (1, "ab b"), (None, "ab b"), (2, None)], "doc_id bigint, text string")
    rows = [(r["doc_id"], r["codes"]) for r in pieces.encode(docs, model).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(1, c := model.merge("▁ab▁b")), (1, c), (None, c), (2, None)]))
    assert {r["restored"] for r in pieces.encode(docs, model, restored=True).collect()} == {True}
    odd = spark.createDataFrame([(1, [10**6])], "doc_id bigint, codes array<int>")
    with pytest.raises(Exception, match="(?i)index|bounds"):
        pieces.decode(odd, model).collect()


def test_one_pass_is_as_good_as_merging_step_by_step(spark):
    """Pieces in an order that no training gives, so that edges are often wanted after their turn."""
    r = random.Random(11)
    names = list({"".join(r.choice("abc") for _ in range(r.randrange(2, 6))) for _ in range(60)})
    model = pieces.Model.of([(p, -float(i)) for i, p in enumerate([*names, "a", "b", "▁"])], bpe=True)
    given = ["".join(r.choice("aabbc ") for _ in range(r.randrange(1, 70))) for _ in range(300)]
    for row in pieces.encode(documents(spark, given), model).collect():
        assert row["codes"] == model.merge(("▁" + row["text"]).replace(" ", "▁")), row["text"]
