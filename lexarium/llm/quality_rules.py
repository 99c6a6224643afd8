"""Operator 7: quality rules by distribution divergence.

Every document has two histograms: of character classes, and of the
``COMMON`` words that are most frequent in its language, with all other words
as one class more. Both are compared to those of the language, counted over
all documents of it, by the Jensen-Shannon distance (base 2, so 0 to 1).
A document with too few characters or words for a histogram is not judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from .store import spread

COMMON = 64
MIN_CHARS, MIN_WORDS = 200, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.31, 0.5

CLASSES = 8
#: a-z, A-Z, 0-9, space, newline, sentence marks, beyond ASCII, all else; -1: not the first byte of a character.
_CLASS = np.full(256, 7, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:!?'\"()-")):
    _CLASS[[ord(_c) for _c in _chars]] = _k
_CLASS[128:192] = -1
_CLASS[192:] = 6


def char_histograms(column: pa.Array) -> np.ndarray:
    """Counts by class, a row for each text."""
    raw, offsets = K.text_bytes(column)
    kind = _CLASS[raw]
    owner = np.repeat(np.arange(len(column)), np.diff(offsets))
    ok = kind >= 0
    return np.bincount(owner[ok] * CLASSES + kind[ok], minlength=len(column) * CLASSES).reshape(-1, CLASSES)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` from the row of counts ``q``; 0 where either is empty."""
    sp, sq = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    a, b = p / np.maximum(sp, 1), q / np.maximum(sq, 1)
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(a > 0, a * np.log2(a / m), 0) + np.where(b > 0, b * np.log2(b / m), 0)
    return np.where((sp[:, 0] > 0) & (sq[:, 0] > 0), np.sqrt(np.maximum(terms.sum(1) / 2, 0)), 0)


def language_references(docs: DataFrame, common: int = COMMON) -> dict[str, dict]:
    """{lang: {"chars": counts by class, "words": {word: count}, "other": count of all other words}}, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(char_histograms(batch.column(1).slice(a, b - a)).tolist(), pa.list_(pa.int64()))], names=["lang", "h"])

    base = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").filter("text is not null")
    chars = base.mapInArrow(count, "lang string, h array<bigint>").groupBy("lang").agg(*(F.sum(F.get("h", F.lit(i))).alias(f"c{i}") for i in range(CLASSES)))
    words = base.select("lang", F.explode(F.split(F.lower("text"), r"[ \t\n\f\r]+")).alias("word")).filter("word <> ''").groupBy("lang", "word").count()
    # the limit on the rank is applied before the shuffle by language; both parts read one exchange
    ranked = words.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("count"), "word"))).filter(F.col("rank") <= common)
    top = ranked.select("lang", "word", F.col("count").alias("n")).union(words.groupBy("lang").agg(F.sum("count").alias("n")).select("lang", F.lit(None).cast("string"), "n"))
    out = {r["lang"]: {"chars": [r[f"c{i}"] for i in range(CLASSES)], "words": {}, "other": 0} for r in chars.collect()}  # a row for each language
    for r in top.collect():  # COMMON + 1 rows for each language
        if r["word"] is None:
            out[r["lang"]]["other"] += r["n"]
        else:
            out[r["lang"]]["words"][r["word"]] = r["n"]
            out[r["lang"]]["other"] -= r["n"]
    return out


class Judge:
    """Both distances of an Arrow array of texts with their languages."""

    def __init__(self, references: dict[str, dict]):
        self.langs = {lang: i for i, lang in enumerate(references)}
        self.size = max([len(r["words"]) for r in references.values()], default=0) + 1
        self.chars = np.array([r["chars"] for r in references.values()] + [[0] * CLASSES], float)
        self.words = np.zeros((len(references) + 1, self.size))
        keys, slots = [], []
        for lang, r in references.items():
            i = self.langs[lang]
            self.words[i, 0] = r["other"]
            for j, (word, n) in enumerate(r["words"].items(), 1):
                self.words[i, j] = n
                keys.append(K.hash_word(word) ^ int(K.mix(np.array([i], np.uint64), 31)[0]))
                slots.append(j)
        order = np.argsort(np.array(keys, np.uint64))
        self.keys, self.slots = np.array(keys, np.uint64)[order], np.array(slots, np.int64)[order]

    def __call__(self, langs: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distance of characters, of words, characters, words)."""
        lang = np.array([self.langs.get(x or "", len(self.langs)) for x in langs.to_pylist()], np.int64)
        chars = char_histograms(texts)
        hashes, first = K.token_hashes(pc.utf8_lower(pc.fill_null(texts, "")))
        owner = K.owners(first)
        key = hashes ^ K.mix(np.arange(len(self.langs) + 1).astype(np.uint64), 31)[lang[owner]]
        slot = np.zeros(len(key), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            slot = np.where(self.keys[at] == key, self.slots[at], 0)
        words = np.bincount(owner * self.size + slot, minlength=len(texts) * self.size).reshape(-1, self.size)
        return divergence(chars, self.chars[lang]), divergence(words, self.words[lang]), chars.sum(1), words.sum(1)


def judged(docs: DataFrame, max_chars: float = MAX_CHAR_DISTANCE, max_words: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Rows (doc_id, char_distance, word_distance, keep), one for each document.

    Words are parted by white space and compared in lower case. A text of
    fewer than ``MIN_CHARS`` characters has a null char_distance, one of fewer
    than ``MIN_WORDS`` words a null word_distance, and what is null rejects
    nothing; so null and empty texts are kept. Documents without a language are
    one language. Rows that repeat are judged one by one; other columns are
    ignored; an empty table gives no rows.
    """
    references = language_references(docs)

    @F.arrow_udf("struct<c:double,w:double>")
    def measure(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        judge = Judge(references)
        for langs, texts in batches:
            parts = [judge(langs.slice(a, b - a), texts.slice(a, b - a)) for a, b in K.slices(texts)]
            c, w, nc, nw = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(4))
            yield pa.StructArray.from_arrays([pa.array(c, mask=nc < MIN_CHARS), pa.array(w, mask=nw < MIN_WORDS)], ["c", "w"])

    found = docs.select("doc_id", measure("lang", "text").alias("m"))
    keep = (F.coalesce("m.c", F.lit(0.0)) <= max_chars) & (F.coalesce("m.w", F.lit(0.0)) <= max_words)
    return found.select("doc_id", F.round("m.c", 4).alias("char_distance"), F.round("m.w", 4).alias("word_distance"), keep.alias("keep"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_LISTED = ", ".join(
    f"length(regexp_replace(text, '{x}', '', 'g'))" for x in ("[^a-z]", "[^A-Z]", "[^0-9]", "[^ ]", r"[^\n]", r"""[^.,;:!?''"()-]""", r"[\x00-\x7F]")
)
OP7_SQL = rf"""
WITH b AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents
), h0 AS (SELECT r, doc_id, lang, length(text) AS n, [{_LISTED}] AS h FROM b
), h AS (SELECT r, doc_id, lang, n, list_append(h, n - list_sum(h)) AS h FROM h0
), q AS (SELECT lang, {", ".join(f"sum(h[{i}]) AS s{i}" for i in range(1, 9))}, sum(n) AS total FROM h GROUP BY lang
), cd AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(h.n) AS n, sqrt(greatest(sum(CASE WHEN a > 0 THEN a * log2(2 * a / (a + z)) ELSE 0 END + CASE WHEN z > 0 THEN z * log2(2 * z / (a + z)) ELSE 0 END) / 2, 0)) AS d
  FROM (SELECT r, doc_id, h.n, unnest(h) / greatest(h.n, 1) AS a, unnest([{", ".join(f"s{i}" for i in range(1, 9))}]) / greatest(total, 1) AS z FROM h JOIN q USING (lang)) h GROUP BY r
), w AS (SELECT r, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\f\r]+'), lambda x: x <> '')) AS word FROM b
), c AS (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k FROM w GROUP BY lang, word
), top AS (SELECT lang, CASE WHEN k <= 64 THEN word END AS word, sum(n) AS n FROM c GROUP BY ALL
), ref AS (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS z FROM top
), p AS (
  SELECT w.r, w.lang, c.word AS word, count(*) AS n FROM w LEFT JOIN (SELECT lang, word FROM c WHERE k <= 64) c ON w.lang = c.lang AND w.word = c.word GROUP BY ALL
), pa AS (SELECT r, lang, word, n / sum(n) OVER (PARTITION BY r) AS a, sum(n) OVER (PARTITION BY r) AS total FROM p
), wd AS (
  SELECT r, any_value(total) AS n, sqrt(greatest((sum(a * log2(2 * a / (a + z)) + z * log2(2 * z / (a + z))) + 1 - sum(z)) / 2, 0)) AS d
  FROM pa JOIN ref ON pa.lang = ref.lang AND pa.word IS NOT DISTINCT FROM ref.word GROUP BY r
)
SELECT cd.doc_id, round(CASE WHEN cd.n >= {MIN_CHARS} THEN cd.d END, 4) AS char_distance, round(CASE WHEN wd.n >= {MIN_WORDS} THEN wd.d END, 4) AS word_distance,
  coalesce(CASE WHEN cd.n >= {MIN_CHARS} THEN cd.d END, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(CASE WHEN wd.n >= {MIN_WORDS} THEN wd.d END, 0) <= {MAX_WORD_DISTANCE} AS keep
FROM cd LEFT JOIN wd USING (r)
"""
