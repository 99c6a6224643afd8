from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexarium.llm import toxicity

from .helpers import ODD, documents, prose

WORDS = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "disgusting", "trash", "loser", "clown")
LEXICON = {"word": dict.fromkeys(WORDS, 6.0), "prefix": {"zorg": 5.0}, "pair": {"blim": 4.0}}


@pytest.fixture(scope="module")
def counts(spark):
    return toxicity.char_counts(documents(spark, [prose(i, 400) for i in range(30)] + ODD))


def brute_viterbi(reader, span):
    """All readings of a short span, by plain recursion over the same lattice."""
    best = (-np.inf, "")
    spaced = len(span) > 2 and span[1] in " .-_*"

    def go(i, p, q, last, score, text):
        nonlocal best
        if i == len(span):
            total = score + reader.logp[p][q][0]
            if total > best[0] + 1e-12:
                best = (total, text)
            return
        ch = span[i]
        if spaced and ch in " .-_*":
            go(i + 1, p, q, last, score + toxicity.P_SEPARATOR, text)
            go(i + 1, q, 0, ch, score + toxicity.P_GAP + reader.logp[p][q][0], text + " ")
            return
        if ch == last and ch.isalpha():
            go(i + 1, p, q, last, score + toxicity.P_REPEAT, text)
        options = [(ch, 0.0)] if "a" <= ch <= "z" else [*((x, toxicity.P_LEET) for x in toxicity.LEET.get(ch, "")), (ch, toxicity.P_LITERAL if ch in toxicity.LEET else 0.0)]
        for x, channel in options:
            c = ord(x) - 96 if "a" <= x <= "z" else toxicity._OTHER
            go(i + 1, q, c, ch, score + channel + reader.logp[p][q][c], text + x)

    go(0, 0, 0, "", 0.0, "")
    return best[1]


@pytest.mark.parametrize("span", ["1d10t", "m0r0n", "5tup1d", "s c u m", "t.r.a.s.h", "cl0wnnn", "looooser", "p4th3t1c", "hello", "l33t"])
def test_viterbi_against_all_readings(counts, span):
    reader = toxicity.Reader(counts, list(LEXICON["word"]))
    assert reader.read(span) == brute_viterbi(reader, span)


@pytest.mark.parametrize("text", ["You 1d10t", "m0r0n", "a s c u m b", "t.r.a.s.h here", "what a l o s e r you are", "cloooown", "$tup1d", "Zorgling", "blimo and Blima"])
def test_toxic(counts, text):
    assert toxicity.Scorer(LEXICON, counts)(pa.array([text]))[0].as_py()["score"] >= toxicity.THRESHOLD


@pytest.mark.parametrize("text", ["idio7", "you idi07!", "worthles5", "worthle55", "s. c. u. m", "s  c  u  m", "i\td\ti\to\tt", "i,d,i,o,t", "i/d/i/o/t", "i-d i-o t", "a s. c. u. m b", "iiddiioott", "idi000t"])
def test_toxic_in_more_disguises(counts, text):
    assert toxicity.Scorer(LEXICON, counts)(pa.array([text]))[0].as_py()["score"] >= toxicity.THRESHOLD


@pytest.mark.parametrize("text", [prose(77, 300), "call 555-0134 at 10:30", "a b c d e", "x86 and mp3 files, room 101", "", None, "blimo", "scumbled idiotic", *ODD])
def test_clean(counts, text):
    assert toxicity.Scorer(LEXICON, counts)(pa.array([text], pa.string()))[0].as_py()["score"] == 0


def test_fit_and_filter(spark):
    texts = [prose(i, 60) + (f" vorka{i % 9}q{i % 7} {prose(i, 3)} vorkb{i % 5}z" if i % 3 == 0 else "") for i in range(150)]
    docs = documents(spark, texts + ODD, extra=True)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"] for r in toxicity.rejected(docs, labels).collect()}
    assert got == {i for i in range(150) if i % 3 == 0}
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(150 + len(ODD))) - got


def test_no_labels_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.rejected(documents(spark, []), none).isEmpty()
    docs = documents(spark, ["you idiot", "fine"])
    assert toxicity.rejected(docs, none).isEmpty() and toxicity.keep_clean(docs, none).count() == 2


def plain_lexicon(rows):
    """What :func:`fit_lexicon` says of whole words and of pure beginnings, by plain loops over (toxic, text)."""
    import re
    from collections import defaultdict
    from math import log

    toxic, clean, contexts, forms = defaultdict(int), defaultdict(int), defaultdict(set), defaultdict(set)
    for bad, text in rows:
        words = re.findall(r"[^\W_]+", text.lower())
        for before, word in zip([None, *words], words):
            if len(word) < 3:
                continue
            for term in [("word", word), *(("prefix", word[:k]) for k in range(toxicity.MIN_PREFIX, min(toxicity.MAX_PREFIX, len(word) - 1) + 1))]:
                (toxic if bad else clean)[term] += 1
                if bad:
                    contexts[term].add((word, before))
                    forms[term].add(word)
    pure = {
        t: len(c)
        for t, c in contexts.items()
        if len(c) >= max(toxicity.MIN_CONTEXTS, toxicity.MIN_SPREAD * toxic[t]) and toxic[t] >= toxicity.PURITY * (toxic[t] + clean[t]) and (t[0] == "word" or len(forms[t]) >= toxicity.MIN_FORMS)
    }
    longest = defaultdict(int)
    for (kind, term), n in pure.items():
        if kind == "prefix":
            longest[term[:-1]] = max(longest[term[:-1]], n)
    return {t: log((toxic[t] + 0.5) / (clean[t] + 0.5)) for t, n in pure.items() if t[0] == "word" or longest[t[1]] < 0.95 * n}


def test_lexicon_against_plain_loops(spark):
    texts = [prose(i, 40) + (f" vorka{i % 7} {prose(i + 999, 2)} grulk {prose(i + 500, 2)} grulk" if i % 3 == 0 else " common") for i in range(180)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(180)], "doc_id bigint, quality int, toxic int")
    got = toxicity.fit_lexicon(documents(spark, texts), labels)
    want = plain_lexicon([(i % 3 == 0, t) for i, t in enumerate(texts)])
    assert ("word", "grulk") in want and any(kind == "prefix" for kind, _ in want)
    assert {(kind, t): w for kind in ("word", "prefix") for t, w in got[kind].items()} == pytest.approx(want)


def test_repeated_rows_and_null_ids(spark):
    texts = [prose(i, 60) + (f" grulk {prose(i + 9, 2)} grulk" if i % 2 else "") for i in range(80)]
    docs = documents(spark, texts)
    again = docs.filter("doc_id = 1").unionByName(docs.filter("doc_id = 1")).unionByName(docs.filter("doc_id = 1").withColumn("doc_id", F.lit(None).cast("bigint")))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id bigint, quality int, toxic int")
    every = docs.unionByName(again)
    got = [r["doc_id"] for r in toxicity.rejected(every, labels).collect()]
    assert got.count(1) == 3 and got.count(None) == 1 and set(got) == {None, *range(1, 80, 2)}
    assert toxicity.keep_clean(every, labels).count() == 40
