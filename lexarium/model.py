"""The tables of a lexicon and its full-text index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEXICON = "dict_id string, ord bigint, key string, entry binary, text string"
METADATA = "dict_id string, name string, version string, format string, entries bigint, description string, author string, language string, file_size bigint, created string, right_to_left boolean"
DOCS = "dict_id string, doc_id bigint, key string, doc_length bigint"
POSTINGS = "dict_id string, term string, doc_id bigint, tf bigint, positions array<int>"
TERMS = "dict_id string, term string, df bigint, cf bigint"


SMALL_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly where it is less than ``SMALL_BYTES`` for each core: a small file may be a single row group, so a single task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_BYTES else df


def lexicon(df: DataFrame, key: str | Column, text: str | Column, ord_: str | Column, dict_id: str | Column | None = None) -> DataFrame:
    """Any table as a lexicon; ``ord_`` is a bigint that tells entries of one dictionary apart and orders them; without ``dict_id`` all are one dictionary."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        (F.lit("main") if dict_id is None else col(dict_id)).cast("string").alias("dict_id"),
        col(ord_).cast("bigint").alias("ord"),
        col(key).cast("string").alias("key"),
        F.encode(col(text).cast("string"), "UTF-8").alias("entry"),
        col(text).cast("string").alias("text"),
    )
