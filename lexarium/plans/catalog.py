"""The queries of the lexicon operators over the test tables, and the SQL that DuckDB can check them with."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium import model
from lexarium.functions import codec, encoding, text
from lexarium.lexicon import Lexicon
from lexarium.operators import index as fts
from lexarium.operators import lookup, search
from lexarium.sources import files, lexicon_source, sinks
from lexarium.workdir import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUERY = "worthless pathetic thorreou"
NATIVE_UTF16 = f"utf-16-{sys.byteorder[0]}e"  # what follows the mark that the codec utf-16 writes

_TOKENS = r"""
t AS (SELECT lang AS dict_id, doc_id, term FROM (SELECT lang, doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '(\p{L}+|\p{N}+)', 1))) AS term FROM documents) WHERE strlen(term) BETWEEN 3 AND 64),
p AS (SELECT dict_id, term, doc_id, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT dict_id, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY ALL),
n AS (SELECT lang AS dict_id, count(*)::DOUBLE AS n FROM documents GROUP BY ALL),
s AS (SELECT dict_id, doc_id, term, (ln(n / (df + 1)) + 1) * (1 + ln(tf)) AS w FROM p JOIN d USING (dict_id, term) JOIN n USING (dict_id))
"""
_LEX = """
l AS (SELECT c_mktsegment AS dict_id, c_custkey AS ord, c_name AS key, 'segment ' || c_mktsegment || ' of nation ' || c_nationkey AS text FROM customer)
"""
_PARTS = """
l AS (SELECT dict_id, ord, key, text FROM (SELECT 'main' AS dict_id, p_partkey AS ord, p_name AS key, p_brand || ' ' || p_type AS text, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS r FROM part) WHERE r = 1)
"""


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def documents(spark: SparkSession, d: str, by_language: bool = True) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return model.lexicon(docs, F.concat(F.lit("doc_"), F.col("doc_id")), "text", "doc_id", F.col("lang") if by_language else None)


_INDEXES: dict[tuple[str, str], fts.FtsIndex] = {}


def index_of(spark: SparkSession, d: str) -> fts.FtsIndex:
    """The saved index of the documents; built by the first query of a session that asks for it."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _INDEXES:
        _INDEXES[at] = fts.save(fts.build(documents(spark, d)), new_path(spark, "index"))
    return _INDEXES[at]


def customers(spark: SparkSession, d: str) -> DataFrame:
    words = F.concat(F.lit("segment "), "c_mktsegment", F.lit(" of nation "), F.col("c_nationkey").cast("string"))
    return model.lexicon(spark.read.parquet(f"{d}/customer.parquet"), "c_name", words, "c_custkey", F.col("c_mktsegment"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return model.lexicon(spark.read.parquet(f"{d}/supplier.parquet"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")), F.concat(F.lit("supplier of nation "), F.col("s_nationkey").cast("string")), "s_suppkey")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return model.lexicon(spark.read.parquet(f"{d}/part.parquet"), "p_name", F.concat_ws(" ", "p_brand", "p_type"), "p_partkey")


@query("fts_search", f"WITH {_TOKENS} SELECT dict_id, doc_id, 'doc_' || doc_id AS key, round(sum(w), 6) AS score FROM s WHERE term IN ('worthless', 'pathetic', 'thorreou') GROUP BY ALL")
def fts_search(spark, d):
    return search.fulltext(index_of(spark, d), QUERY)


@query("fts_topk", f"WITH {_TOKENS} SELECT dict_id, doc_id, 'doc_' || doc_id AS key, round(sum(w), 6) AS score FROM s WHERE term IN ('worthless', 'pathetic', 'thorreou') GROUP BY ALL ORDER BY score DESC, dict_id, doc_id LIMIT 20")
def fts_topk(spark, d):
    return search.fulltext(index_of(spark, d), QUERY, 20)


@query(
    "fts_many",
    rf"""WITH {_TOKENS}, q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '(\p{{L}}+|\p{{N}}+)', 1))) AS term FROM benchmark) WHERE strlen(term) BETWEEN 3 AND 64),
    r AS (SELECT query_id, dict_id, doc_id, round(sum(w), 6) AS score FROM q JOIN s USING (term) GROUP BY ALL)
    SELECT query_id, dict_id, doc_id, 'doc_' || doc_id AS key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dict_id, doc_id)::INTEGER AS rank FROM r) WHERE rank <= 10""",
)
def fts_many(spark, d):
    return search.fulltext_many(index_of(spark, d), spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query("fts_saved_index", f"WITH {_TOKENS} SELECT dict_id, doc_id, 'doc_' || doc_id AS key, round(sum(w), 6) AS score FROM s WHERE term IN ('worthless', 'pathetic', 'thorreou') GROUP BY ALL")
def fts_saved_index(spark, d):
    return search.fulltext(fts.save(fts.build(documents(spark, d)), new_path(spark, "index")), QUERY)


@query("fts_terms", f"WITH {_TOKENS} SELECT dict_id, term, df, cf FROM d")
def fts_terms(spark, d):
    return index_of(spark, d).terms


@query("fts_postings", f"WITH {_TOKENS} SELECT dict_id, term, doc_id, tf FROM p")
def fts_postings(spark, d):
    return index_of(spark, d).postings.select("dict_id", "term", "doc_id", "tf")


@query("fts_statistics", f"WITH {_TOKENS} SELECT n.dict_id, n::BIGINT AS documents, vocabulary, round(tokens / n, 6) AS average_length, tokens FROM n JOIN (SELECT dict_id, count(*) AS vocabulary, sum(cf)::BIGINT AS tokens FROM d GROUP BY ALL) USING (dict_id)")
def fts_statistics(spark, d):
    return fts.statistics(index_of(spark, d)).withColumn("average_length", F.round("average_length", 6))


@query("fts_term_counts", f"WITH {_TOKENS} SELECT term, coalesce(sum(df), 0)::BIGINT AS df, coalesce(sum(cf), 0)::BIGINT AS cf FROM (VALUES ('the'), ('thorreou'), ('nowhere')) v(term) LEFT JOIN d USING (term) GROUP BY ALL")
def fts_term_counts(spark, d):
    return fts.term_counts(index_of(spark, d), spark.createDataFrame([("the",), ("thorreou",), ("nowhere",)], "term string"))


@query("fts_term_prefix", f"WITH {_TOKENS} SELECT term, sum(df)::BIGINT AS df, sum(cf)::BIGINT AS cf FROM d WHERE term LIKE 'thor%' GROUP BY ALL")
def fts_term_prefix(spark, d):
    return fts.term_prefix(index_of(spark, d), "thor")


@query("fts_vocabulary_size", f"WITH {_TOKENS} SELECT count(DISTINCT term) AS vocabulary FROM d")
def fts_vocabulary_size(spark, d):
    return fts.vocabulary_size(index_of(spark, d))


@query("fts_average_length", f"WITH {_TOKENS} SELECT round(sum(tf) / (SELECT count(*) FROM documents), 6) AS average_length FROM p")
def fts_average_length(spark, d):
    return fts.average_length(index_of(spark, d)).select(F.round("average_length", 6).alias("average_length"))


@query("fts_build", f"WITH {_TOKENS} SELECT n.dict_id, n::BIGINT AS documents, vocabulary, round(tokens / n, 6) AS average_length, tokens FROM n JOIN (SELECT dict_id, count(*) AS vocabulary, sum(cf)::BIGINT AS tokens FROM d GROUP BY ALL) USING (dict_id)")
def fts_build(spark, d):
    """Builds and saves a new index each time, for the queries after it too; what it holds is told from the saved tables."""
    _INDEXES.pop((spark.sparkContext.applicationId, d), None)
    return fts.statistics(index_of(spark, d)).withColumn("average_length", F.round("average_length", 6))


@query("fts_validate", "SELECT * FROM (VALUES ('term without postings', 0::BIGINT), ('postings without term', 0), ('wrong counts', 0), ('postings without document', 0)) v(problem, n)")
def fts_validate(spark, d):
    return fts.validate(index_of(spark, d))


@query(
    "fts_validate_broken",
    rf"""WITH {_TOKENS} SELECT 'term without postings' AS problem, 1::BIGINT AS n
    UNION ALL SELECT 'postings without term', count(*) FROM d WHERE term LIKE 'tho%'
    UNION ALL SELECT 'wrong counts', count(*) FROM d WHERE term LIKE 'wor%'
    UNION ALL SELECT 'postings without document', count(*) FROM p WHERE doc_id % 50 = 0""",
)
def fts_validate_broken(spark, d):
    """An index with terms and documents taken out, counts changed and a term added: every fault is found."""
    index = index_of(spark, d)
    terms = index.terms.filter(~F.col("term").startswith("tho")).withColumn("df", F.col("df") + F.col("term").startswith("wor").cast("int"))
    added = spark.createDataFrame([("en", "no such term", 1, 1)], "dict_id string, term string, df bigint, cf bigint")
    return fts.validate(fts.FtsIndex(index.docs.filter("doc_id % 50 <> 0"), index.postings, terms.union(added), index.settings))


@query("fts_stop_words", rf"WITH {_TOKENS} SELECT dict_id, count(*)::BIGINT AS tokens FROM t WHERE term NOT IN ({', '.join(repr(w) for w in text.STOP_WORDS)}) GROUP BY ALL")
def fts_stop_words(spark, d):
    return fts.statistics(fts.build(documents(spark, d), text.STOP_WORDS)).select("dict_id", "tokens")


@query("fts_entries", rf"WITH {_TOKENS} SELECT dict_id, doc_id, round(sum(w), 6) AS score, md5(any_value(text)) AS entry_md5 FROM s JOIN documents USING (doc_id) WHERE term IN ('worthless', 'pathetic', 'thorreou') GROUP BY ALL")
def fts_entries(spark, d):
    lex = documents(spark, d)
    return search.fulltext_entries(index_of(spark, d), lex, QUERY).select("dict_id", "doc_id", "score", F.md5("entry").alias("entry_md5"))


@query("tokenize", r"SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '(\p{L}+|\p{N}+)', 1), lambda x: lower(x)), lambda x: strlen(x) BETWEEN 3 AND 64)) AS tokens FROM documents")
def tokenize(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(text.tokenize("text")).cast("bigint").alias("tokens"))


@query("snippet", "SELECT doc_id, CASE WHEN i > 0 THEN substring(text, greatest(i - 1 - 20, 0) + 1, least(i - 1 + 40, length(text)) - greatest(i - 1 - 20, 0)) END AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'thor') AS i FROM documents)")
def snippet(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.snippet("text", ["thor"], 40).alias("snippet"))


@query("strip_tags", "SELECT page_id, md5(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) AS plain FROM pages")
def strip_tags(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(text.strip_tags("html")).alias("plain"))


@query("get", f"WITH {_PARTS} SELECT * FROM l WHERE key = (SELECT min(p_name) FROM part)")
def get(spark, d):
    lex = parts(spark, d)
    first = spark.read.parquet(f"{d}/part.parquet").agg(F.min("p_name").alias("key"))
    return lookup.latest(lex.join(F.broadcast(first), "key", "left_semi")).select("dict_id", "ord", "key", "text")


@query("get_literal", f"WITH {_LEX} SELECT * FROM l WHERE key = 'Customer#000000007'")
def get_literal(spark, d):
    return lookup.get(customers(spark, d), "Customer#000000007").select("dict_id", "ord", "key", "text")


@query("contains", "SELECT replace(s_name, 'Supplier', 'Customer') AS key, replace(s_name, 'Supplier', 'Customer') IN (SELECT c_name FROM customer) AS found FROM supplier")
def contains(spark, d):
    return lookup.contains(customers(spark, d), suppliers(spark, d).select("key"))


@query("get_many", f"WITH {_LEX} SELECT o_orderkey AS pos, k AS key, text, CASE WHEN text IS NULL THEN 'Key not found' END AS error FROM (SELECT o_orderkey, 'Customer#' || lpad((o_custkey * 2)::VARCHAR, 9, '0') AS k FROM orders) LEFT JOIN l ON l.key = k")
def get_many(spark, d):
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("key"))
    return lookup.get_many(customers(spark, d), asked).select("pos", "key", "text", "error")


@query("keys", "SELECT DISTINCT p_name AS key FROM part")
def keys(spark, d):
    return lookup.keys(parts(spark, d))


@query("entries", f"WITH {_PARTS} SELECT * FROM l")
def entries(spark, d):
    return lookup.entries(parts(spark, d)).select("dict_id", "ord", "key", "text")


@query("values", f"WITH {_PARTS} SELECT md5(text) AS entry_md5 FROM l")
def values(spark, d):
    return lookup.values(parts(spark, d)).select(F.md5("entry").alias("entry_md5"))


@query("size", "SELECT c_mktsegment AS dict_id, count(DISTINCT c_name) AS entries FROM customer GROUP BY ALL")
def size(spark, d):
    return lookup.size(customers(spark, d))


@query("key_range", f"WITH {_LEX} SELECT * FROM l WHERE key BETWEEN 'Customer#000000010' AND 'Customer#000000099'")
def key_range(spark, d):
    return lookup.key_range(customers(spark, d), "Customer#000000010", "Customer#000000099").select("dict_id", "ord", "key", "text")


@query("prefix", f"WITH {_LEX} SELECT * FROM l WHERE starts_with(key, 'Customer#00000') ORDER BY key, dict_id LIMIT 100")
def prefix(spark, d):
    return lookup.prefix(customers(spark, d), "Customer#00000").select("dict_id", "ord", "key", "text")


@query("prefix_all", f"WITH {_LEX} SELECT * FROM l WHERE starts_with(key, 'Customer#0000001')")
def prefix_all(spark, d):
    return lookup.prefix(customers(spark, d), "Customer#0000001", None).select("dict_id", "ord", "key", "text")


@query("ordinal_range", f"WITH {_LEX} SELECT * FROM l ORDER BY key, dict_id LIMIT 50 OFFSET 25")
def ordinal_range(spark, d):
    return lookup.ordinal_range(customers(spark, d), 25, 75).select("dict_id", "ord", "key", "text")


@query("bounds", "SELECT count(DISTINCT CASE WHEN c_name < 'Customer#000000050' THEN c_name END) AS lower_bound, count(DISTINCT CASE WHEN c_name <= 'Customer#000000050' THEN c_name END) AS upper_bound FROM customer")
def bounds(spark, d):
    lex = customers(spark, d)
    low, high = lookup.lower_bound(lex, "Customer#000000050"), lookup.upper_bound(lex, "Customer#000000050")
    return low.select(F.col("position").alias("lower_bound")).crossJoin(high.select(F.col("position").alias("upper_bound")))


@query("substring", f"WITH {_PARTS} SELECT * FROM l WHERE contains(lower(text), 'brand#1')")
def substring(spark, d):
    return lookup.substring(parts(spark, d), "BRAND#1").select("dict_id", "ord", "key", "text")


@query("key_or_text", f"WITH {_PARTS} SELECT * FROM l WHERE contains(key, 're') OR contains(text, 're')")
def key_or_text(spark, d):
    return lookup.key_or_text(parts(spark, d), "re").select("dict_id", "ord", "key", "text")


@query(
    "key_order",
    """WITH l AS (SELECT c_mktsegment AS dict_id, c_custkey AS ord, CASE WHEN c_custkey % 97 = 0 THEN 'A' || c_name WHEN c_custkey % 31 = 0 THEN 'Customer#000000001' ELSE c_name END AS key FROM customer)
    SELECT * FROM (SELECT dict_id, ord, key, lag(key) OVER (PARTITION BY dict_id ORDER BY ord) AS before FROM l) WHERE before >= key""",
)
def key_order(spark, d):
    """Keys in the order of ``ord``, some of which are out of place or repeat."""
    key = F.when(F.col("ord") % 97 == 0, F.concat(F.lit("A"), "key")).when(F.col("ord") % 31 == 0, "Customer#000000001").otherwise(F.col("key"))
    return lookup.out_of_order(customers(spark, d).withColumn("key", key))


@query("key_order_sorted", "SELECT 0::BIGINT AS out_of_order")
def key_order_sorted(spark, d):
    """A sorted lexicon as it is written: positions in the files are its order."""
    path = new_path(spark, "sorted")
    lookup.write_sorted(lookup.latest(customers(spark, d)), path)
    placed = spark.read.parquet(path).select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("place"))
    return lookup.out_of_order(placed, "place").agg(F.count(F.lit(1)).alias("out_of_order"))


@query("sorted_lexicon", f"WITH {_LEX} SELECT * FROM l WHERE key BETWEEN 'Customer#000000010' AND 'Customer#000000099'")
def sorted_lexicon(spark, d):
    path = new_path(spark, "sorted")
    lookup.write_sorted(customers(spark, d), path)
    return lookup.key_range(spark.read.parquet(path), "Customer#000000010", "Customer#000000099").select("dict_id", "ord", "key", "text")


@query("fuzzy", "SELECT 'main' AS dict_id, key, distance::INTEGER AS distance, 1.0 / (1.0 + distance) AS score FROM (SELECT DISTINCT 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') AS key, levenshtein('Customer#' || lpad(s_suppkey::VARCHAR, 9, '0'), 'Customer#000000012') AS distance FROM supplier) WHERE distance <= 2")
def fuzzy(spark, d):
    return search.fuzzy(suppliers(spark, d), "Customer#000000012")


@query("fuzzy_many", "SELECT w.word, k.key, levenshtein(k.key, w.word)::INTEGER AS distance FROM (SELECT DISTINCT p_name AS key FROM part) k, (SELECT DISTINCT substr(p_name, 2) AS word FROM part) w WHERE levenshtein(k.key, w.word) <= 2")
def fuzzy_many(spark, d):
    words = spark.read.parquet(f"{d}/part.parquet").select(F.expr("substr(p_name, 2)").alias("word"))
    return search.fuzzy_many(parts(spark, d), words)


@query("suggest", r"SELECT term, distance::INTEGER AS distance FROM (SELECT DISTINCT term, levenshtein(term, 'brandd') AS distance FROM (SELECT lower(unnest(regexp_extract_all(p_brand || ' ' || p_type, '(\p{L}+|\p{N}+)', 1))) AS term FROM part) WHERE strlen(term) BETWEEN 3 AND 64) WHERE distance <= 2 ORDER BY distance, term LIMIT 10")
def suggest(spark, d):
    return search.suggest(fts.build(parts(spark, d)), "brandd")


@query("search_multiple_fulltext", f"WITH {_TOKENS} SELECT dict_id AS source_dict, 'doc_' || doc_id AS key, round(sum(w), 6) AS score FROM s WHERE term IN ('worthless', 'pathetic', 'thorreou') GROUP BY dict_id, doc_id")
def search_multiple_fulltext(spark, d):
    return search.search_multiple(documents(spark, d), QUERY, search.Kind.FULLTEXT, index_of(spark, d))


@query("search_multiple_fuzzy", "SELECT c_mktsegment AS source_dict, c_name AS key, 1.0 / (1.0 + levenshtein(c_name, 'Customer#000000012')) AS score FROM customer WHERE levenshtein(c_name, 'Customer#000000012') <= 2")
def search_multiple_fuzzy(spark, d):
    return search.search_multiple(customers(spark, d), "Customer#000000012", search.Kind.FUZZY)


@query("search_multiple_prefix", "SELECT source_dict, key, NULL::DOUBLE AS score FROM (SELECT c_mktsegment AS source_dict, c_name AS key, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS r FROM customer WHERE c_name LIKE 'Customer#00000%') WHERE r <= 100")
def search_multiple_prefix(spark, d):
    return search.search_multiple(customers(spark, d), "Customer#00000", search.Kind.PREFIX)


@query("merge", f"WITH {_LEX}, s AS (SELECT s_suppkey AS ord, replace(s_name, 'Supplier', 'Customer') AS key, 'supplier of nation ' || s_nationkey AS text FROM supplier) SELECT 'merged' AS dict_id, ord, key, text, 'main' AS source_dict FROM s UNION ALL SELECT 'merged', ord, key, text, dict_id FROM l WHERE key NOT IN (SELECT key FROM s)")
def merge(spark, d):
    return search.merge([customers(spark, d), suppliers(spark, d)]).drop("entry")


@query("integrity", "SELECT 'main' AS dict_id, p_name AS key, 'duplicate key' AS problem FROM part GROUP BY p_name HAVING count(*) > 1")
def integrity(spark, d):
    return search.integrity(parts(spark, d))


@query("secure_hash", "SELECT doc_id, upper(sha256(text)) AS hash FROM documents")
def secure_hash(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.hex(codec.secure_hash(F.encode("text", "UTF-8"))).alias("hash"))


@query("compression", "SELECT page_id, algorithm, md5(html) AS md5 FROM pages, (VALUES ('none'), ('gzip'), ('lz4'), ('zstd')) v(algorithm)")
def compression(spark, d):
    pages, out = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.encode("html", "UTF-8").alias("html")), None
    for algorithm in codec.LEVELS:
        one = pages.select("page_id", F.lit(algorithm).alias("algorithm"), F.md5(codec.decompress(codec.compress("html", algorithm), algorithm)).alias("md5"))
        out = one if out is None else out.unionByName(one)
    return out


@query("compression_settings", "SELECT * FROM (VALUES ('none', false, false, 1.0::DOUBLE, 'very fast', 0::BIGINT), ('gzip', true, false, 2.5, 'fast', 262144), ('lz4', true, true, 2.0, 'very fast', 65536), ('zstd', true, true, 3.5, 'medium', 524288)) v(algorithm, streaming, dictionary, ratio, speed, memory_bytes)")
def compression_settings(spark, d):
    return codec.settings(spark)


@query("estimated_ratio", "SELECT range::INTEGER AS level, round(least(least(range, 9) / 9.0::DOUBLE * 2 + 1, 4), 6) AS gzip, round(2 + range / 10.0::DOUBLE, 6) AS lz4, round(least(least(range, 19) / 19.0::DOUBLE * 4 + 1.5, 6), 6) AS zstd FROM range(23)")
def estimated_ratio(spark, d):
    level = F.col("id").cast("int")
    return spark.range(23).select(level.alias("level"), *(F.round(codec.estimated_ratio(a, level), 6).alias(a) for a in ("gzip", "lz4", "zstd")))


@query(
    "adler32",
    """WITH h AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(regexp_extract_all(h, '..')) AS h FROM h),
    v AS (SELECT doc_id, n, i, (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1 AS x FROM u),
    s AS (SELECT doc_id, (1 + sum(x)) % 65521 AS a, (any_value(n) + sum((n - i) * x)) % 65521 AS b FROM v GROUP BY doc_id)
    SELECT doc_id, coalesce(b * 65536 + a, 1)::BIGINT AS adler32 FROM h LEFT JOIN s USING (doc_id)""",
)
def adler32(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").filter("text is not null").select("doc_id", codec.adler32(F.encode("text", "UTF-8")).alias("adler32"))


@query("checksums")
def checksums(spark, d):
    """No SQL; tests hold them against other implementations."""
    data = F.encode("text", "UTF-8")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", codec.crc32(data).alias("crc32"), codec.adler32(data).alias("adler32"), codec.fast_hash(data).alias("fast_hash"))


@query("detect_encoding", "SELECT doc_id, mark, CASE WHEN mark <> '' THEN name WHEN strlen(text) = 0 THEN 'Unknown' ELSE 'UTF-8' END AS encoding FROM documents, (VALUES ('', 'UTF-8'), ('EFBBBF', 'UTF-8'), ('FFFE', 'UTF-16LE'), ('FEFF', 'UTF-16BE')) v(mark, name) WHERE text IS NOT NULL")
def detect_encoding(spark, d):
    """Every text without a byte-order mark and with each of three."""
    docs, out = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null"), None
    for mark, charset in (("", "UTF-8"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE")):
        data = F.concat(F.unhex(F.lit(mark)), F.encode("text", charset))
        one = docs.select("doc_id", F.lit(mark).alias("mark"), encoding.detect_encoding(data).alias("encoding"))
        out = one if out is None else out.union(one)
    return out


@query("to_utf8", "SELECT doc_id, name, md5(text) AS md5 FROM documents, (VALUES ('UTF-8'), ('UTF-16LE'), ('UTF-16BE'), ('ISO-8859-1')) v(name) WHERE text IS NOT NULL AND (name <> 'ISO-8859-1' OR NOT regexp_matches(text, '[^\\x{00}-\\x{FF}]'))")
def to_utf8(spark, d):
    """Every text in each encoding that can hold it."""
    docs, out = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null"), None
    for name in ("UTF-8", "UTF-16LE", "UTF-16BE", "ISO-8859-1"):
        some = docs.filter(~F.col("text").rlike(r"[^\x{00}-\x{FF}]")) if name == "ISO-8859-1" else docs
        one = some.select("doc_id", F.lit(name).alias("name"), F.md5(encoding.to_utf8(F.encode("text", name), name)).alias("md5"))
        out = one if out is None else out.union(one)
    return out


@query("encoding_properties", "SELECT * FROM (VALUES ('UTF-8', true, true, 4), ('UTF-16LE', true, false, 2), ('UTF-16BE', true, false, 2), ('Windows-1252', false, false, 1), ('ISO-8859-1', false, false, 1), ('GB2312', false, true, 2), ('Big5', false, true, 2), ('Shift-JIS', false, true, 2), ('EUC-KR', false, true, 2), ('Unknown', false, false, 1)) v(name, is_unicode, is_variable_width, max_char_bytes)")
def encoding_properties(spark, d):
    return encoding.properties(spark).drop("common_in")


@query("sanitize", r"SELECT page_id, md5(regexp_replace(left(chr(7) || url || chr(10) || html, 1000), '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]', '', 'g')) AS clean FROM pages")
def sanitize(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(text.sanitize(F.substring(F.concat(F.lit("\x07"), "url", F.lit("\n"), "html"), 1, 1000))).alias("clean"))


@query("generated_pairs", "SELECT range AS ord, 'word_' || lpad(range::VARCHAR, 6, '0') AS key FROM range(1000)")
def generated_pairs(spark, d):
    return sinks.pairs(1000, spark).select("ord", "key")


def _source(format_: str, tail: str, shown: str = "text") -> None:
    @query(f"source_{format_}", f"WITH {_LEX} SELECT dict_id || '.{tail}' AS dict_id, key, {shown} AS text FROM l")
    def run(spark, d):
        found = sinks.write_containers(customers(spark, d), new_path(spark, format_), format_)
        return lexicon_source.load(spark, *found).select("dict_id", "key", "text")


_source("stardict", "ifo")
_source("dsl", "dsl", "'[m1]' || text || '[/m]'")
_source("bgl", "bglx")
_source("zim", "zim")
_source("mdict", "mdx")


@query("dsl_cards", f"WITH {_LEX} SELECT dict_id || '.dsl' AS dict_id, key, text AS plain, ord % 2 = 0 AS has_media, ord % 3 = 0 AS has_transcription, ['m1'] AS margin_tags FROM l")
def dsl_cards(spark, d):
    """Cards with tags for media and transcription, and what the table of their tags says."""
    tagged = F.concat(F.when(F.col("ord") % 2 == 0, "[s]").otherwise("[b]"), "text", F.when(F.col("ord") % 2 == 0, "[/s]").otherwise("[/b]"), F.when(F.col("ord") % 3 == 0, "[t][/t]").otherwise(""))
    lines = customers(spark, d).select("dict_id", "ord", F.concat("key", F.lit("\n\t[m1]"), tagged, F.lit("[/m]\n")).alias("card"))
    folder = new_path(spark, "dsl")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Files are written as their cards come, so that no task holds one."""
        pieces = ((name, "".join(card for _, card in rows)) for b in batches for name, rows in groupby(zip(b.column("dict_id").to_pylist(), b.column("card").to_pylist()), itemgetter(0)))
        for name, parts in groupby(pieces, itemgetter(0)):
            path = f"{folder}/{name}.dsl"
            files.write_parts(path, chain(['#NAME "cards"\n\n'.encode("utf-16")], (part.encode(NATIVE_UTF16) for _, part in parts)))
            yield pa.RecordBatch.from_pydict({"file": [path]})

    placed = lines.repartition("dict_id").sortWithinPartitions("dict_id", "ord")
    found = sorted(r["file"] for r in placed.mapInArrow(put, "file string").collect())  # a row for each dictionary
    return lexicon_source.dsl_cards(spark, *found).select("dict_id", "key", "plain", "has_media", "has_transcription", "margin_tags")


@query("merge_saved", f"WITH {_LEX}, s AS (SELECT s_suppkey AS ord, replace(s_name, 'Supplier', 'Customer') AS key, 'supplier of nation ' || s_nationkey AS text FROM supplier) SELECT count(*) AS entries, sum(strlen(text))::BIGINT AS text_bytes, (SELECT count(*) FROM s) AS with_supplier FROM (SELECT key, text FROM s UNION ALL SELECT key, text FROM l WHERE key NOT IN (SELECT key FROM s))")
def merge_saved(spark, d):
    """A merge written with its index in one go, then loaded and asked."""
    merged = Lexicon.merge([Lexicon(customers(spark, d)), Lexicon(suppliers(spark, d))], path=new_path(spark, "merged")).reload()
    hits = search.fulltext(merged.index, "supplier").agg(F.count(F.lit(1)).alias("with_supplier"))
    return merged.entries.agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("text")).alias("text_bytes")).crossJoin(hits)


@query("metadata", "SELECT c_mktsegment || '.ifo' AS dict_id, c_mktsegment AS name, 'stardict' AS format, count(*) AS entries FROM customer GROUP BY c_mktsegment")
def metadata(spark, d):
    found = sinks.write_containers(customers(spark, d), new_path(spark, "stardict"), "stardict")
    return lexicon_source.metadata(spark, *found).select("dict_id", "name", "format", "entries")


@query("supported_formats", "SELECT * FROM (VALUES ('mdict'), ('stardict'), ('zim'), ('dsl'), ('bgl')) v(format)")
def supported_formats(spark, d):
    return lexicon_source.supported_formats(spark)
