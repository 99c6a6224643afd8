"""Point, batch and ordered access to a lexicon.

Exact keys and ranges are plain predicates, so they reach the Parquet scan; a
lexicon written by :func:`write_sorted` has its keys in order, and row-group
statistics leave few groups to read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexarium.errors import IndexMissing
from lexarium.workdir import new_path

PREFIX_LIMIT = 100
BROADCAST_KEYS = 100_000


def latest(lex: DataFrame) -> DataFrame:
    """One entry of each key of a dictionary: the last by ``ord``."""
    last = lex.withColumn("__n", F.row_number().over(W.partitionBy("dict_id", "key").orderBy(F.desc("ord"), F.desc("entry"))))
    return last.filter("__n = 1").drop("__n")


def get(lex: DataFrame, key: str) -> DataFrame:
    """The last entry of ``key``: no row or one for each dictionary."""
    return latest(lex.filter(F.col("key") == key))


def get_or_raise(lex: DataFrame, key: str):
    found = get(lex, key).first()
    if found is None:
        raise IndexMissing(f"Key not found: {key}")
    return found


binary_search_get = get


def contains(lex: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (column key) with ``found``."""
    known = lex.select("key").distinct().withColumn("__hit", F.lit(True))
    return keys.join(known, "key", "left").select(*keys.columns, F.coalesce("__hit", F.lit(False)).alias("found"))


def get_many(lex: DataFrame, keys: DataFrame, small: bool | None = None) -> DataFrame:
    """Rows (pos, key, entry, text, error), one for each row (pos, key) of ``keys``; what is missing has an error.

    Few keys (``small``; counted where it is not told) are sent to all tasks
    to filter the lexicon before anything is shuffled.
    """
    if small is None:
        small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    asked = keys.select("key").distinct()
    found = latest(lex.join(F.broadcast(asked) if small else asked, "key", "left_semi")).select("key", "entry", "text")
    out = keys.select("pos", "key").join(found, "key", "left")
    return out.select("pos", "key", "entry", "text", F.when(F.col("entry").isNull(), F.lit("Key not found")).alias("error"))


def key_positions(spark, keys: Iterable[str]) -> DataFrame:
    """A list of keys as rows (pos, key)."""
    return spark.createDataFrame(list(enumerate(keys)), "pos bigint, key string")


def keys(lex: DataFrame) -> DataFrame:
    return lex.select("key").distinct()


def values(lex: DataFrame) -> DataFrame:
    return latest(lex).select("entry")


def entries(lex: DataFrame) -> DataFrame:
    """All entries in the order of their keys."""
    return latest(lex).orderBy("key", "dict_id")


def size(lex: DataFrame) -> DataFrame:
    return lex.groupBy("dict_id").agg(F.countDistinct("key").alias("entries"))


def key_range(lex: DataFrame, low: str, high: str) -> DataFrame:
    """Keys from ``low`` to ``high``, both included, in order."""
    return latest(lex.filter(F.col("key").between(low, high))).orderBy("key", "dict_id")


def prefix(lex: DataFrame, start: str, limit: int | None = PREFIX_LIMIT) -> DataFrame:
    """The first ``limit`` keys that begin with ``start``, in order; all of them where it is None."""
    found = latest(lex.filter(F.col("key").startswith(start))).orderBy("key", "dict_id")
    return found if limit is None else found.limit(limit)


def ordinal_range(lex: DataFrame, start: int, end: int) -> DataFrame:
    """Entries number ``start`` up to but not ``end`` in the order of keys; what lies beyond the last is not there."""
    return latest(lex).orderBy("key", "dict_id").offset(max(start, 0)).limit(max(end - max(start, 0), 0))


def lower_bound(lex: DataFrame, key: str) -> DataFrame:
    """Number of keys below ``key``."""
    return lex.filter(F.col("key") < key).agg(F.countDistinct("key").alias("position"))


def upper_bound(lex: DataFrame, key: str) -> DataFrame:
    """Number of keys up to ``key``."""
    return lex.filter(F.col("key") <= key).agg(F.countDistinct("key").alias("position"))


def _last_of(lex: DataFrame, found: DataFrame) -> DataFrame:
    """Of the entries ``found`` by their text those that are the last of their key: only keys and what was found is shuffled."""
    key = ["dict_id", "key"]
    last = lex.select(*key, "ord").join(found.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.max("ord").alias("ord"))
    return latest(found.join(last, [*key, "ord"], "left_semi"))


def substring(lex: DataFrame, part: str) -> DataFrame:
    """Entries whose text has ``part`` in it, whatever the case."""
    return _last_of(lex, lex.filter(F.contains(F.lower("text"), F.lower(F.lit(part)))))


def key_or_text(lex: DataFrame, part: str) -> DataFrame:
    return _last_of(lex, lex.filter(F.contains("key", F.lit(part)) | F.contains("text", F.lit(part))))


def write_sorted(lex: DataFrame, path: str, partitions: int | None = None) -> None:
    """The lexicon by key: range-partitioned, sorted inside, so that a key or range touches few row groups."""
    ranged = lex.repartitionByRange(partitions, "dict_id", "key") if partitions else lex.repartitionByRange("dict_id", "key")
    ranged.sortWithinPartitions("dict_id", "key", "ord").write.mode("overwrite").parquet(path)


def out_of_order(lex: DataFrame, order: Column | str = "ord") -> DataFrame:
    """Rows (dict_id, ord, key, before) of entries whose key is not above the one before it: none in a valid key index.

    Keys are dealt to ranges of that order, written once, and compared inside
    each range; then the last key of a range with the first of the next.
    """
    path = new_path(lex.sparkSession, "order")
    ranged = lex.select("dict_id", "ord", "key", F.col(order).alias("__at") if isinstance(order, str) else order.alias("__at")).repartitionByRange("dict_id", "__at")
    ranged.withColumn("__range", F.spark_partition_id()).write.parquet(path)
    written = lex.sparkSession.read.parquet(path)
    inside = written.withColumn("before", F.lag("key").over(W.partitionBy("dict_id", "__range").orderBy("__at")))
    edges = written.groupBy("dict_id", "__range").agg(F.min(F.struct("__at", "ord", "key")).alias("head"), F.max_by("key", "__at").alias("last"))
    # a row for each dictionary and range
    edges = edges.withColumn("before", F.lag("last").over(W.partitionBy("dict_id").orderBy("__range")))
    every = inside.select("dict_id", "ord", "key", "before").union(edges.select("dict_id", "head.ord", "head.key", "before"))
    return every.filter(F.col("before") >= F.col("key"))


def follow_links(lex: DataFrame, most: int = 8) -> DataFrame:
    """Entries that only point to another headword take its text; chains are followed ``most`` steps and cycles stay as they are."""
    from lexarium.functions.text import entry_links

    current = latest(lex).withColumn("__to", entry_links("text"))
    target = current.select(F.col("dict_id").alias("__d"), F.col("key").alias("__k"), F.col("entry").alias("__e"), F.col("text").alias("__t"), F.col("__to").alias("__next"))
    for _ in range(most):
        hit = (F.col("dict_id") == F.col("__d")) & (F.col("__to") == F.col("__k"))
        joined = current.join(target, hit, "left")
        current = joined.select("dict_id", "ord", "key", F.coalesce("__e", "entry").alias("entry"), F.coalesce("__t", "text").alias("text"), F.col("__next").alias("__to"))
    return current.drop("__to")
