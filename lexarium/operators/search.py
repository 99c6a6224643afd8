"""Full-text, fuzzy and combined search, and merging of collections."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexarium.errors import InvalidFormat
from lexarium.functions.text import fuzzy_distance, fuzzy_score, snippet

from . import index as fts
from . import lookup

DIGITS = 6
#: Terms of queries, and with them their weights in each dictionary, that every task may hold.
BROADCAST_TERMS = 200_000


class Kind(Enum):
    PREFIX = "prefix"
    FUZZY = "fuzzy"
    FULLTEXT = "fulltext"


def query_tokens(spark: SparkSession, index: fts.FtsIndex, query: str) -> list[str]:
    """Distinct terms of a query. The one-row plan is folded by the optimizer; no job runs."""
    found = spark.range(1).select(F.array_distinct(index.settings.tokens(F.lit(query))).alias("t"))
    return sorted(found.first()["t"])


def _buckets(spark: SparkSession, index: fts.FtsIndex, tokens: list[str]) -> list[int]:
    """The folders in which the postings of these terms lie; again a plan that is folded."""
    if not tokens:
        return []
    each = [fts.bucket_of(F.lit(t), F.lit(salt), index.buckets) for t in tokens for salt in range(fts.SALTS)]
    return sorted(set(spark.range(1).select(F.array(*each).alias("b")).first()["b"]))


def fulltext(index: fts.FtsIndex, query: str, limit: int | None = None) -> DataFrame:
    """Rows (dict_id, doc_id, key, score) of documents with any term of the query, best first, ties by doc_id.

    The score is the sum over terms of ``(ln(N / (df + 1)) + 1) * (1 + ln tf)``,
    with N and df of the document's own dictionary. The terms are literals of
    the plan, so they reach the scan of the postings.
    """
    spark = index.docs.sparkSession
    tokens = query_tokens(spark, index, query)
    hits = index.postings.filter(F.col("term").isin(tokens))
    if index.buckets:
        hits = hits.filter(F.col("bucket").isin(_buckets(spark, index, tokens)))
    terms = index.terms.filter(F.col("term").isin(tokens)).select("dict_id", "term", "df")
    sizes = index.docs.groupBy("dict_id").agg(F.count(F.lit(1)).alias("n"))
    # a row for each dictionary and query term; whether that is little enough to be broadcast is seen when it is there
    weights = terms.join(sizes, "dict_id").select("dict_id", "term", (F.log(F.col("n") / (F.col("df") + 1)) + 1).alias("idf"))
    scored = hits.join(weights, ["dict_id", "term"]).groupBy("dict_id", "doc_id").agg(F.sum(F.col("idf") * (1 + F.log("tf"))).alias("score"))
    named = scored.join(index.docs.select("dict_id", "doc_id", "key"), ["dict_id", "doc_id"])
    out = named.select("dict_id", "doc_id", "key", F.round("score", DIGITS).alias("score")).orderBy(F.desc("score"), "dict_id", "doc_id")
    return out if limit is None else out.limit(limit)


def fulltext_many(index: fts.FtsIndex, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Rows (query_id, dict_id, doc_id, key, score, rank): the ``limit`` best documents of every query (query_id, query).

    Postings of terms that are asked for meet by document, and there each of
    them meets the queries of its term: so a frequent term is no single task,
    and what is shuffled does not grow with the queries. Those of more than
    ``BROADCAST_TERMS`` terms meet the postings as Spark sees fit.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(index.settings.tokens("query"))).alias("term")).distinct()
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda df: df
    sizes = index.docs.groupBy("dict_id").agg(F.count(F.lit(1)).alias("n"))
    known = index.terms.join(small(asked.select("term").distinct()), "term", "left_semi")
    weights = known.join(sizes, "dict_id").select("dict_id", "term", (F.log(F.col("n") / (F.col("df") + 1)) + 1).alias("idf"))
    hits = index.postings.select("dict_id", "term", "doc_id", "tf").join(small(weights), ["dict_id", "term"])
    hits = hits.select("dict_id", "doc_id", "term", (F.col("idf") * (1 + F.log("tf"))).alias("w")).repartition("dict_id", "doc_id")
    scored = hits.join(small(asked), "term").groupBy("query_id", "dict_id", "doc_id").agg(F.round(F.sum("w"), DIGITS).alias("score"))
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "dict_id", "doc_id"))).filter(F.col("rank") <= limit)
    return best.join(index.docs.select("dict_id", "doc_id", "key"), ["dict_id", "doc_id"]).select("query_id", "dict_id", "doc_id", "key", "score", "rank")


def fulltext_entries(index: fts.FtsIndex, lex: DataFrame, query: str, limit: int | None = None, size: int = 100) -> DataFrame:
    """Full-text hits with their entries and a snippet around the first term."""
    hits = fulltext(index, query, limit)
    tokens = query_tokens(index.docs.sparkSession, index, query)
    joined = hits.join(lex.select("dict_id", F.col("ord").alias("doc_id"), "entry", "text"), ["dict_id", "doc_id"])
    return joined.select("dict_id", "doc_id", "key", "score", "entry", snippet("text", tokens, size).alias("snippet")).orderBy(F.desc("score"), "dict_id", "doc_id")


def fuzzy(lex: DataFrame, word: str, most: int = 2) -> DataFrame:
    """Rows (dict_id, key, distance, score) of keys within ``most`` edits, nearest first."""
    found = lookup.latest(lex).withColumn("distance", fuzzy_distance("key", F.lit(word), most)).filter("distance is not null")
    return found.select("dict_id", "key", "distance", fuzzy_score("distance").alias("score")).orderBy(F.desc("score"), "key", "dict_id")


def fuzzy_many(lex: DataFrame, words: DataFrame, most: int = 2) -> DataFrame:
    """Rows (word, key, distance) for all words at once.

    A key within k edits has one of k+1 even parts of the word in it, at most
    k places away (pigeonhole), and a length within k; so both sides meet on
    (length, part number, part) and only those pairs are compared.
    """
    parts = most + 1
    keys = lex.select("key").distinct().withColumn("n", F.length("key"))
    asked = words.select("word").distinct().withColumn("m", F.length("word"))
    indexed = keys.select("key", "n", F.explode(F.expr(f"transform(sequence(0, {most}), i -> struct(i as i, substring(key, cast(floor(n * i / {parts}) as int) + 1, cast(floor(n * (i + 1) / {parts}) - floor(n * i / {parts}) as int)) as piece))")).alias("x")).select("key", "n", "x.*")
    probes = asked.select("word", "m", F.explode(F.sequence(F.greatest(F.col("m") - most, F.lit(0)), F.col("m") + most)).alias("n"))
    probes = probes.select("word", "n", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("i"))
    probes = probes.withColumn("a", F.expr(f"cast(floor(n * i / {parts}) as int)")).withColumn("l", F.expr(f"cast(floor(n * (i + 1) / {parts}) as int)") - F.col("a"))
    probes = probes.select("word", "n", "i", F.explode(F.expr(f"array_distinct(transform(sequence(greatest(a - {most}, 0), a + {most}), s -> substring(word, s + 1, l)))")).alias("piece"))
    pairs = probes.join(indexed, ["n", "i", "piece"]).select("word", "key").distinct()
    return pairs.withColumn("distance", fuzzy_distance("key", "word", most)).filter("distance is not null")


def suggest(index: fts.FtsIndex, word: str, most: int = 2, limit: int = 10) -> DataFrame:
    """The ``limit`` nearest terms within ``most`` edits of ``word``, as it is written."""
    near = index.terms.select("term").distinct().withColumn("distance", fuzzy_distance("term", F.lit(word), most)).filter("distance is not null")
    return near.orderBy("distance", "term").limit(limit)


def search_multiple(lex: DataFrame, query: str, kind: Kind, index: fts.FtsIndex | None = None, limit: int | None = None, most: int = 2) -> DataFrame:
    """Rows (source_dict, key, score) over all dictionaries of a lexicon, best first; prefix hits have no score and come last.

    ``limit`` holds for each dictionary, as statistics do.
    """
    if kind is Kind.FULLTEXT:
        found = fulltext(index if index is not None else fts.build(lex), query).select("dict_id", "key", "score")
    elif kind is Kind.FUZZY:
        found = fuzzy(lex, query, most).select("dict_id", "key", "score")
    else:
        found = lookup.prefix(lex, query, None).select("dict_id", "key", F.lit(None).cast("double").alias("score"))
        limit = lookup.PREFIX_LIMIT if limit is None else limit
    order = [F.coalesce("score", F.lit(0.0)).desc(), F.col("key").asc()]
    if limit is not None:
        found = found.withColumn("__n", F.row_number().over(W.partitionBy("dict_id").orderBy(*order))).filter(F.col("__n") <= limit).drop("__n")
    return found.select(F.col("dict_id").alias("source_dict"), "key", "score").orderBy(*order, "source_dict")


def stream(lex: DataFrame, query: str, index: fts.FtsIndex | None = None, limit: int = 256):
    """Keys of hits one by one, without holding them all: full text with an index, else by prefix."""
    found = fulltext(index, query).select("key") if index is not None else lookup.prefix(lex, query, limit).select("key")
    return (r["key"] for r in found.toLocalIterator())


def merge(lexicons: Sequence[DataFrame], name: str | None = None) -> DataFrame:
    """One lexicon of all keys, in order; of a key in several the last lexicon's last entry stays."""
    if not lexicons:
        raise InvalidFormat("nothing to merge")
    every = None
    for at, lex in enumerate(lexicons):
        part = lex.withColumn("__at", F.lit(at))
        every = part if every is None else every.unionByName(part)
    last = every.withColumn("__n", F.row_number().over(W.partitionBy("key").orderBy(F.desc("__at"), F.desc("ord"), F.desc("entry")))).filter("__n = 1")
    title = F.lit(name if name is not None else "merged")
    return last.select(title.alias("dict_id"), "ord", "key", "entry", "text", F.col("dict_id").alias("source_dict")).orderBy("key")


def merged_metadata(metadata: DataFrame, entries: DataFrame) -> DataFrame:
    """The metadata of a merge: ``Merged: a + b``, with the number of entries."""
    names = metadata.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dict_id", "name"))), lambda x: x["name"]), " + ").alias("names"))
    return names.crossJoin(entries.agg(F.count(F.lit(1)).alias("entries"))).select(F.when(F.col("names") == "", "Merged Dictionary").otherwise(F.concat(F.lit("Merged: "), "names")).alias("name"), "entries")


def integrity(lex: DataFrame) -> DataFrame:
    """Rows (dict_id, key, problem) of keys that repeat, empty keys and empty entries."""
    repeated = lex.groupBy("dict_id", "key").count().filter("count > 1").select("dict_id", "key", F.lit("duplicate key").alias("problem"))
    empty = lex.filter((F.col("key") == "") | F.col("key").isNull()).select("dict_id", "key", F.lit("empty key").alias("problem"))
    blank = lex.filter(F.col("entry").isNull() | (F.octet_length("entry") == 0)).select("dict_id", "key", F.lit("empty entry").alias("problem"))
    return repeated.union(empty).union(blank)
