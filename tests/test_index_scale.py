"""The full-text index where rows repeat or lack numbers, and what its plans bring together."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexarium import model
from lexarium.operators import index as fts
from lexarium.operators import search

ROWS = [(None, 1, "alpha beta gamma"), ("d", 2, "alpha alpha"), ("d", 2, "beta alpha"), ("d", 3, ""), ("d", None, "alpha delta"), ("e", 2, "beta")]


def lexicon(spark, rows):
    return model.lexicon(spark.createDataFrame(rows, "d string, i bigint, v string"), F.concat_ws("_", "d", "i"), "v", "i", "d")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return fts.save(fts.build(lexicon(spark, ROWS)), str(tmp_path_factory.mktemp("odd")))


def test_postings_are_made_document_by_document(spark):
    index = fts.build(lexicon(spark, [(d, i, "alpha beta alpha") for i, d in enumerate("abcdefgh")]))
    found = fts._postings(index)
    assert "hashpartitioning" not in plan(found) and "posexplode" not in plan(found)
    assert {(r["term"], r["tf"], tuple(r["positions"])) for r in found.collect()} == {("alpha", 2, (0, 2)), ("beta", 1, (1,))}


def test_rows_that_share_a_number(odd):
    got = {(r["dict_id"], r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in odd.postings.collect()}
    assert got == {
        (None, "alpha", 1): (1, [0]), (None, "beta", 1): (1, [1]), (None, "gamma", 1): (1, [2]),
        ("d", "alpha", 2): (3, [0, 1, 1]), ("d", "beta", 2): (1, [0]),
        ("d", "alpha", None): (1, [0]), ("d", "delta", None): (1, [1]), ("e", "beta", 2): (1, [0]),
    }
    assert sorted(r["doc_length"] for r in odd.docs.collect()) == [0, 1, 2, 2, 2, 3]
    assert fts.average_length(odd).first()[0] == 10 / 6


def test_saved_postings_equal_those_of_the_plan(spark, tmp_path):
    words = ["one", "two", "three", "four", "éclair", "two2two"]
    rows = [("ab"[i % 2], i, " ".join(words[(i * k) % 6] for k in range(i % 40))) for i in range(300)]
    index = fts.build(lexicon(spark, rows))
    saved = fts.save(index, str(tmp_path / "i"))
    table = lambda df: sorted(tuple(map(str, r)) for r in df.select("dict_id", "term", "doc_id", "tf", "positions").collect())
    assert table(saved.postings) == table(index.postings)
    assert sorted(map(tuple, saved.docs.collect())) == sorted(map(tuple, index.docs.collect()))
    assert sorted(map(tuple, saved.terms.collect())) == sorted(map(tuple, index.terms.collect()))


def test_folders_hold_their_own_terms(odd):
    wrong = odd.postings.filter(F.col("bucket") != fts.bucket_of(F.col("term"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(fts.SALTS)), odd.buckets))
    assert wrong.isEmpty()


def test_frequent_terms_of_many_queries_meet_by_document(spark):
    index = fts.build(lexicon(spark, [("d", i, "alpha " + ("beta" if i == 3 else "gamma delta")) for i in range(9)] + [("e", 3, "beta alpha alpha")]))
    asked = spark.createDataFrame([(1, "alpha Gamma"), (2, "Beta"), (3, "nothing")], "query_id bigint, query string")
    found = search.fulltext_many(index, asked, 2)
    assert "REPARTITION_BY_COL" in plan(found)
    assert [tuple(r)[:3] for r in found.orderBy("query_id", "rank").collect()] == [(1, "d", 0), (1, "d", 1), (2, "d", 3), (2, "e", 3)]


def test_documents_without_dictionary_are_no_fault(spark, odd):
    assert {r["problem"]: r["n"] for r in fts.validate(odd).collect()} == dict.fromkeys(("term without postings", "postings without term", "wrong counts", "postings without document"), 0)
    broken = fts.FtsIndex(odd.docs.filter("doc_id is not null"), odd.postings.filter("term <> 'gamma'"), odd.terms.filter("term <> 'delta'").withColumn("cf", F.when(F.col("term") == "beta", 9).otherwise(F.col("cf"))), odd.settings)
    assert {r["problem"]: r["n"] for r in fts.validate(broken).collect()} == {"term without postings": 1, "postings without term": 1, "wrong counts": 3, "postings without document": 2}
