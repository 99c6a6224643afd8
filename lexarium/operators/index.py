"""The full-text index: tables of documents, postings and terms, kept as Parquet.

Saved postings lie in folders by hash of the term and are sorted inside, so the
terms of a query choose folders and prune row groups; texts stay out of them. A
term is dealt to ``SALTS`` folders by document, so that a very frequent one is no
single task.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.errors import IndexMissing, InvalidFormat
from lexarium.functions.text import MAX_TERM_BYTES, MIN_TERM_BYTES, tokenize
from lexarium.model import DOCS, POSTINGS, TERMS, spread

VERSION = 2
SALTS = 4
_BATCH_ROWS = 1 << 16


@dataclass
class Settings:
    """How texts became terms; queries must use the same."""

    stop_words: list[str] = field(default_factory=list)
    min_bytes: int = MIN_TERM_BYTES
    max_bytes: int = MAX_TERM_BYTES

    def tokens(self, text):
        return tokenize(text, self.stop_words, self.min_bytes, self.max_bytes)


@dataclass
class FtsIndex:
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    settings: Settings
    buckets: int = 0  # folders of the postings, where they are saved
    tokens: DataFrame | None = None  # (dict_id, doc_id, t) where it is not saved yet

    @property
    def built(self) -> bool:
        return not self.docs.isEmpty()


def build(lex: DataFrame, stop_words: Iterable[str] = (), min_bytes: int = MIN_TERM_BYTES, max_bytes: int = MAX_TERM_BYTES) -> FtsIndex:
    """The index of a lexicon; every row is a document of its own, with ``ord`` as its number. Documents without terms count."""
    settings = Settings(sorted(set(stop_words)), min_bytes, max_bytes)
    lex = spread(lex)
    tokens = lex.select("dict_id", F.col("ord").alias("doc_id"), "key", settings.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    docs = tokens.select("dict_id", "doc_id", "key", F.size("t").cast("bigint").alias("doc_length"))
    each = tokens.select("dict_id", "doc_id", F.posexplode("t").alias("pos", "term"))
    postings = each.groupBy("dict_id", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return FtsIndex(docs, postings, _terms(each.groupBy("dict_id", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))), settings, tokens=tokens.select("dict_id", "doc_id", "t"))


def _terms(counts: DataFrame) -> DataFrame:
    return counts.groupBy("dict_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bucket_of(term: Column, salt: Column, buckets: int) -> Column:
    """The folder of a posting."""
    return F.pmod(F.xxhash64(term) + salt, F.lit(buckets))


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dict_id, term, doc_id, tf, positions) of documents (dict_id, doc_id, t); those of a batch in order of term and document."""
    for batch in batches:
        lists, rows = batch.column("t"), batch.num_rows
        words = lists.flatten().dictionary_encode()
        if not len(words):
            continue
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        by_doc = pc.sort_indices(pa.table({"d": batch.column("dict_id"), "n": batch.column("doc_id")}), [("d", "ascending"), ("n", "ascending")]).to_numpy()
        by_word = pc.sort_indices(words.dictionary).to_numpy()
        doc_rank, word_rank = np.empty(rows, np.int64), np.empty(len(by_word), np.int64)
        doc_rank[by_doc], word_rank[by_word] = np.arange(rows), np.arange(len(by_word))
        where = word_rank[words.indices.to_numpy()] * rows + np.repeat(doc_rank, sizes)
        places = np.arange(len(where), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(where, kind="stable")  # so that positions stay in order
        where = where[order]
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        ends = np.r_[starts[1:], len(where)]
        word, doc = by_word[where[starts] // rows], pa.array(by_doc[where[starts] % rows])
        positions = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(where)], pa.int32()), pa.array(places[order], pa.int32()))
        columns = [batch.column("dict_id").take(doc), words.dictionary.take(pa.array(word)), batch.column("doc_id").take(doc), pa.array(ends - starts, pa.int64()), positions]
        found = pa.RecordBatch.from_arrays(columns, names=["dict_id", "term", "doc_id", "tf", "positions"])
        for at in range(0, found.num_rows, _BATCH_ROWS):
            yield found.slice(at, _BATCH_ROWS)


def _postings(index: FtsIndex) -> DataFrame:
    """The postings of an index that is not saved yet: made document by document, since only numbers that several rows share need them brought together."""
    twice = index.docs.groupBy("dict_id", "doc_id").count().filter("count > 1").select("dict_id", "doc_id")
    made = lambda tokens: tokens.mapInArrow(_invert, POSTINGS)
    if twice.isEmpty():
        return made(index.tokens)
    a, b = index.tokens.alias("a"), twice.alias("b")
    same = F.col("a.dict_id").eqNullSafe(F.col("b.dict_id")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    shared = made(a.join(b, same, "left_semi")).groupBy("dict_id", "term", "doc_id").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return made(a.join(b, same, "left_anti")).unionByName(shared)


def save(index: FtsIndex, path: str) -> FtsIndex:
    """Write the index; terms are counted from the postings as written. A folder of the postings is one task."""
    spark = index.docs.sparkSession
    buckets = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    postings = index.postings if index.tokens is None else _postings(index)
    salt = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SALTS))
    placed = postings.withColumn("bucket", bucket_of(F.col("term"), salt, buckets)).repartitionById(buckets, F.col("bucket").cast("int"))
    order = ["bucket", "term", "dict_id", "doc_id"]
    placed.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    written = spark.read.schema(f"{POSTINGS}, bucket bigint").parquet(f"{path}/postings")
    _terms(written.select("dict_id", "term", "tf")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    docs = index.docs
    if index.tokens is None:
        lengths = written.groupBy("dict_id", "doc_id").agg(F.sum("tf").alias("doc_length"))
        docs = docs.select("dict_id", "doc_id", "key").join(lengths, ["dict_id", "doc_id"], "left").withColumn("doc_length", F.coalesce("doc_length", F.lit(0)).cast("bigint"))
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    meta = json.dumps({"version": VERSION, "settings": asdict(index.settings), "buckets": buckets})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> FtsIndex:
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    except Exception as e:
        raise IndexMissing(f"no index at {path}") from e
    if meta.get("version") != VERSION:
        raise InvalidFormat(f"index version {meta.get('version')}, not {VERSION}")
    schemas = {"docs": DOCS, "postings": f"{POSTINGS}, bucket bigint", "terms": TERMS}
    tables = (spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in schemas.items())
    return FtsIndex(*tables, Settings(**meta["settings"]), meta["buckets"])


def validate(index: FtsIndex) -> DataFrame:
    """Rows (problem, n) of what is wrong; all n are 0 in a valid index.

    Terms are told and counted in one aggregation; documents, the smaller
    side, are hashed, so that postings need not be sorted to meet them.
    """
    told = index.terms.select("dict_id", "term", "df", "cf", F.lit(1).alias("told"), F.lit(0).alias("seen"), F.lit(0).alias("tf"))
    seen = index.postings.select("dict_id", "term", F.lit(None).cast("bigint").alias("df"), F.lit(None).cast("bigint").alias("cf"), F.lit(0).alias("told"), F.lit(1).alias("seen"), "tf")
    both = told.union(seen).groupBy("dict_id", "term").agg(
        *(f(c).alias(f"{name}_{c}") for c in ("df", "cf") for name, f in (("least", F.min), ("most", F.max))),
        *(F.sum(c).alias(c) for c in ("told", "seen", "tf")),
    )
    wrong = (F.col("least_df") != F.col("seen")) | (F.col("most_df") != F.col("seen")) | (F.col("least_cf") != F.col("tf")) | (F.col("most_cf") != F.col("tf"))
    checks = both.agg(
        F.coalesce(F.sum(F.when(F.col("seen") == 0, F.col("told"))), F.lit(0)).alias("term without postings"),
        F.count_if(F.col("told") == 0).alias("postings without term"),
        F.count_if((F.col("told") > 0) & (F.col("seen") > 0) & wrong).alias("wrong counts"),
    )
    a, b = index.postings.select("dict_id", "doc_id").alias("a"), index.docs.select("dict_id", "doc_id").hint("shuffle_hash").alias("b")
    same = F.col("a.dict_id").eqNullSafe(F.col("b.dict_id")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    lost = a.join(b, same, "left_anti").agg(F.count(F.lit(1)).alias("postings without document"))
    one = checks.crossJoin(lost)
    return one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("problem", "n"))


def statistics(index: FtsIndex) -> DataFrame:
    """Rows (dict_id, documents, vocabulary, average_length, tokens)."""
    docs = index.docs.groupBy("dict_id").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("average_length"), F.sum("doc_length").alias("tokens"))
    words = index.terms.groupBy("dict_id").agg(F.count(F.lit(1)).alias("vocabulary"))
    return docs.join(words, "dict_id", "left").select("dict_id", "documents", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), "average_length", "tokens")


def term_counts(index: FtsIndex, terms: DataFrame) -> DataFrame:
    """``terms`` (column term) with df and cf over all dictionaries, 0 where unknown."""
    known = index.terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return terms.join(known, "term", "left").fillna(0, ["df", "cf"])


def term_prefix(index: FtsIndex, start: str) -> DataFrame:
    """All terms that begin with ``start``, in order."""
    return index.terms.filter(F.col("term").startswith(start)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).orderBy("term")


def vocabulary_size(index: FtsIndex) -> DataFrame:
    return index.terms.agg(F.countDistinct("term").alias("vocabulary"))


def average_length(index: FtsIndex) -> DataFrame:
    return index.docs.agg(F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("average_length"))
