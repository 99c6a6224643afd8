"""The document pipeline: toxicity, line dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexarium.llm import jaccard, line_dedup, packing, suffix, toxicity
from lexarium.llm.store import stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rejected as toxic go; the others stay as they are.

    Null and empty texts and null ids are clean, very long texts are read
    whole, rows that repeat are judged one by one, extra columns stay, and an
    empty table (or one without labels) loses nothing.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; documents keep their columns.

    Of equal lines the first by (doc_id, line number) stays. A document whose
    lines all go goes; null and empty texts and rows without doc_id stay; rows
    that repeat doc_id and text are cut alike; an empty table stays empty.
    """
    return line_dedup.drop_lines(docs, line_dedup.ALL_LINES)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id.

    Null, empty and blank texts and rows without doc_id are in no group and
    stay; rows that repeat the kept doc_id stay; an empty table stays empty.
    """
    return jaccard.keep_one(docs)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier go; documents keep their columns.

    Of equal passages the first by (doc_id, position) stays. A document of
    which nothing is left goes; null, empty and shorter texts and rows without
    doc_id stay; rows that repeat doc_id and text are cut alike; an empty
    table stays empty.
    """
    return suffix.drop_spans(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in its bin.

    Null, empty and blank texts have no piece; a null doc_id stays null; rows
    that repeat are packed once each; long documents are cut at the capacity;
    extra columns are left out; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("suffix-array dedup", dedup_passages),
    ("best-fit packing", pack_documents),
]

#: Fitting, near-duplicate components and packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
