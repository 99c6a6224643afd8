from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lexarium import model
from lexarium.errors import IndexMissing, InvalidFormat
from lexarium.lexicon import Lexicon
from lexarium.operators import index as fts
from lexarium.operators import lookup, search
from lexarium.sources import sinks
from lexarium.streaming.lookup import get_stream

GLOSSARY = {
    "computer": "An electronic machine that runs a program",
    "compiler": "A program that translates a programming language",
    "database": "An organized store of data structure",
    "algorithm": "A procedure of steps, an algorithm design",
    "language": "A system of signs; a programming language",
    "empty": "",
}


@pytest.fixture(scope="module")
def lex(spark):
    rows = [(i, k, v) for i, (k, v) in enumerate(GLOSSARY.items())]
    return model.lexicon(spark.createDataFrame(rows, "i bigint, k string, v string"), "k", "v", "i").cache()


def keys(df):
    return [r["key"] for r in df.collect()]


def test_get(spark, lex):
    assert lookup.get(lex, "computer").first()["text"] == GLOSSARY["computer"]
    assert keys(lookup.get(lex, "nothing")) == []
    with pytest.raises(IndexMissing):
        lookup.get_or_raise(lex, "nothing")


def test_last_wins(spark):
    df = model.lexicon(spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", None)], "i bigint, k string, v string"), "k", "v", "i")
    assert [(r["key"], r["text"]) for r in lookup.entries(df).collect()] == [("a", "y"), ("b", None)]


def test_get_many(spark, lex):
    asked = lookup.key_positions(spark, ["compiler", "nothing", "compiler", ""])
    for small in (True, False, None):
        got = [tuple(r) for r in lookup.get_many(lex, asked, small).orderBy("pos").select("pos", "key", "error").collect()]
        assert got == [(0, "compiler", None), (1, "nothing", "Key not found"), (2, "compiler", None), (3, "", "Key not found")]
    assert {r["key"]: r["found"] for r in lookup.contains(lex, asked.select("key")).collect()} == {"compiler": True, "nothing": False, "": False}


def test_order(spark, lex):
    assert keys(lookup.prefix(lex, "comp")) == ["compiler", "computer"]
    assert keys(lookup.prefix(lex, "c", 1)) == ["compiler"] and keys(lookup.prefix(lex, "c", 0)) == []
    assert keys(lookup.key_range(lex, "algorithm", "computer")) == ["algorithm", "compiler", "computer"]
    assert keys(lookup.ordinal_range(lex, 1, 3)) == ["compiler", "computer"]
    assert keys(lookup.ordinal_range(lex, 90, 99)) == [] and keys(lookup.ordinal_range(lex, 4, 99)) == ["empty", "language"]
    assert lookup.lower_bound(lex, "computer").first()[0] == 2 and lookup.upper_bound(lex, "computer").first()[0] == 3


def test_prefix_reaches_the_scan(spark, lex, tmp_path):
    lookup.write_sorted(lex, str(tmp_path / "s"))
    plan = spark.read.parquet(str(tmp_path / "s")).filter(F.col("key").startswith("comp"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "StringStartsWith(key,comp)" in plan
    assert lookup.out_of_order(spark.read.parquet(str(tmp_path / "s")), "key").isEmpty()


def test_fulltext_by_hand(spark, lex):
    index = fts.build(lex)
    got = {r["key"]: r["score"] for r in search.fulltext(index, "Programming language nowhere").collect()}
    idf = lambda df: math.log(6 / (df + 1)) + 1
    each = idf(2) + idf(2)
    assert got == {"compiler": round(each, 6), "language": round(each, 6)}
    assert search.fulltext(index, "!").isEmpty()
    assert [tuple(r) for r in search.fulltext_many(index, spark.createDataFrame([(1, "data"), (2, "")], "query_id bigint, query string")).select("query_id", "key").collect()] == [(1, "database")]
    hit = search.fulltext_entries(index, lex, "algorithm", size=10).first()
    assert hit["key"] == "algorithm" and "algorithm" in hit["snippet"]


def test_index_tables(spark, lex, tmp_path):
    index = fts.save(fts.build(lex, ["the"]), str(tmp_path / "i"))
    assert index.settings.stop_words == ["the"] and index.built
    assert all(r["n"] == 0 for r in fts.validate(index).collect())
    assert fts.statistics(index).first()["documents"] == 6
    assert index.postings.filter("term = 'programming' and doc_id = 1").first()["positions"] == [3]
    broken = fts.FtsIndex(index.docs, index.postings.filter("term <> 'data'"), index.terms, index.settings)
    assert {r["problem"]: r["n"] for r in fts.validate(broken).collect()}["term without postings"] == 1
    with pytest.raises(IndexMissing):
        fts.load(spark, str(tmp_path / "nothing"))


def test_fuzzy(spark):
    df = model.lexicon(spark.createDataFrame([(i, w) for i, w in enumerate(("hello", "hell", "helo", "world", "é"))], "i bigint, k string"), "k", "k", "i")
    assert [tuple(r) for r in search.fuzzy(df, "hello").select("key", "distance", "score").collect()] == [("hello", 0, 1.0), ("hell", 1, 0.5), ("helo", 1, 0.5)]
    words = spark.createDataFrame([("hello",), ("wrld",), ("e",), ("",)], "word string")
    got = {tuple(r) for r in search.fuzzy_many(df, words, 2).collect()}
    brute = {(w, k, d) for w in ("hello", "wrld", "e", "") for k in ("hello", "hell", "helo", "world", "é") if (d := _levenshtein(w, k)) <= 2}
    assert got == brute


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_suggest(spark, lex):
    assert [r["term"] for r in search.suggest(fts.build(lex), "programm").collect()] == ["program"]


def test_many_dictionaries(spark):
    rows = [("d1", i, f"shared_{i:03d}", f"first text {i}") for i in range(20)] + [("d2", i, f"shared_{i:03d}", f"second text {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "d string, i bigint, k string, v string")
    two = model.lexicon(df, "k", "v", "i", "d")
    assert search.search_multiple(two, "shared_00", search.Kind.PREFIX, limit=3).count() == 6
    assert {r["source_dict"] for r in search.search_multiple(two, "second", search.Kind.FULLTEXT).collect()} == {"d2"}
    merged = search.merge([two.filter("dict_id = 'd1'"), two.filter("dict_id = 'd2'")])
    assert merged.count() == 20 and {r["source_dict"] for r in merged.collect()} == {"d2"}
    with pytest.raises(InvalidFormat):
        search.merge([])
    meta = spark.createDataFrame([("1", "A"), ("2", "B")], "dict_id string, name string")
    assert tuple(search.merged_metadata(meta, merged).first()) == ("Merged: A + B", 20)


def test_integrity(spark, lex):
    bad = model.lexicon(spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "", "z"), (4, "c", None)], "i bigint, k string, v string"), "k", "v", "i")
    assert {(r["key"], r["problem"]) for r in search.integrity(bad).collect()} == {("a", "duplicate key"), ("", "empty key"), ("c", "empty entry")}


def test_links(spark):
    df = model.lexicon(spark.createDataFrame([(1, "a", "@@@LINK=b"), (2, "b", "@@@LINK=c"), (3, "c", "end"), (4, "x", "@@@LINK=x")], "i bigint, k string, v string"), "k", "v", "i")
    assert {r["key"]: r["text"] for r in lookup.follow_links(df).collect()} == {"a": "end", "b": "end", "c": "end", "x": "@@@LINK=x"}


def test_facade_and_stream(spark, lex, tmp_path):
    saved = Lexicon(lex).save(str(tmp_path / "lexicon"))
    assert saved.fulltext("programming").count() == 2 and saved.prefix("comp").count() == 2 and saved.integrity().count() == 1
    assert saved.get_many(["compiler"]).first()["error"] is None
    assert Lexicon.merge([saved, saved]).entries.count() == 6
    with pytest.raises(IndexMissing):
        Lexicon(lex).suggest("x")
    assert len(list(search.stream(lex, "c"))) == 2
    lookup.key_positions(spark, ["compiler", "no"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pos bigint, key string").parquet(str(tmp_path / "in"))
    run = get_stream(lex, stream).select("key", "error").writeStream.format("memory").queryName("found").start()
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("found").collect()} == {("compiler", None), ("no", "Key not found")}


def test_empty(spark):
    none = model.lexicon(spark.createDataFrame([], "i bigint, k string, v string"), "k", "v", "i")
    assert not fts.build(none).built and fts.average_length(fts.build(none)).first()[0] == 0.0
    assert lookup.entries(none).isEmpty() and search.fulltext(fts.build(none), "word").isEmpty() and search.integrity(none).isEmpty()
    assert sinks.pairs(3, spark).count() == 3
