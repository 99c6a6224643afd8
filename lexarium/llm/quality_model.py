"""Operator 5: a factorisation machine that rates the quality of documents.

Features are hashed words (log counts, scaled to unit length), structure
statistics in steps (length, share of letters, digits, signs and capitals,
word and line lengths, repeated words and lines) and metadata (language,
source). The score is ``w0 + w.x + sum over pairs <v_i, v_j> x_i x_j``; the
pairs cost linear time by the sum-of-squares identity
``((sum v_i x_i)^2 - sum (v_i x_i)^2) / 2``.

The model is fitted on at most ``FIT_ROWS`` labelled documents (those with the
least hashes of their ids) with AdaGrad over mini-batches in a fixed order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import spread

FIT_ROWS = 8_000
BUCKETS = 1 << 15
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.08, 1e-5
#: A document is kept from this probability of good quality on.
KEEP = 0.2

_STATS = 9
_STEPS = 12
_META = 512
WIDTH = BUCKETS + _STATS * _STEPS + 2 * _META
_KIND = np.zeros(256, np.int64)
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[9, 10, 12, 13, 32]] = 4


def _per(sums: np.ndarray, total: np.ndarray) -> np.ndarray:
    return sums / np.maximum(total, 1)


def _repeated(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(share of repeats, owner, hash, count) of distinct items."""
    owner = K.owners(first)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([start, [len(h)]]))
    distinct = np.bincount(o[start], minlength=len(first) - 1)
    return 1 - _per(distinct, np.diff(first)) * (np.diff(first) > 0), o[start], h[start], count


def features(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, index, value): text d has the features index[first[d]:first[d+1]]; nulls count as empty."""
    n = len(texts)
    raw, offsets = K.text_bytes(texts)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 5 + _KIND[raw], minlength=n * 5).reshape(-1, 5)
    hashes, first = K.token_hashes(pc.utf8_lower(pc.fill_null(texts, "")))
    lines, line_first = _line_hashes(raw, offsets)
    again, word_owner, word, count = _repeated(hashes, first)
    line_again, _, _, _ = _repeated(lines, line_first)
    tokens = np.diff(first)
    stats = np.stack(
        [
            np.log2(size + 1) / 16,
            _per(kinds[:, 1], size),
            _per(kinds[:, 2], size) * 4,
            _per(kinds[:, 3], size) * 4,
            _per(kinds[:, 0], size) * 4,
            _per(size - kinds[:, 4], tokens) / 16,
            np.log2(_per(tokens, np.diff(line_first)) + 1) / 8,
            again,
            line_again,
        ],
        1,
    )
    step = np.clip((stats * _STEPS).astype(np.int64), 0, _STEPS - 1)
    weight = np.log1p(count)
    norm = np.sqrt(np.bincount(word_owner, weight**2, n))
    doc = np.arange(n)
    meta = [np.array([K.hash_word(x) if x else 0 for x in column.to_pylist()], np.uint64) % np.uint64(_META) for column in (langs, sources)]
    where = np.concatenate([word_owner, np.repeat(doc, _STATS), doc, doc])
    index = np.concatenate([(word % np.uint64(BUCKETS)).astype(np.int64), (BUCKETS + np.arange(_STATS) * _STEPS + step).ravel(), BUCKETS + _STATS * _STEPS + meta[0].astype(np.int64), BUCKETS + _STATS * _STEPS + _META + meta[1].astype(np.int64)])
    value = np.concatenate([weight / np.maximum(norm, 1e-9)[word_owner], np.full(n * _STATS, 0.33), np.full(2 * n, 0.33)])
    order = np.argsort(where, kind="stable")
    return np.searchsorted(where[order], np.arange(n + 1)), index[order].astype(np.int32), value[order].astype(np.float32)


def _line_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.ones(256, bool)
    inside[10] = False
    starts, ends, first = K.token_spans(raw, offsets, inside)
    return K.span_hash(K.prefix_sums(K.BYTE_CODE[raw]), starts, ends), first


class Machine:
    """Weights of the machine; scores and gradients in time linear in the features."""

    def __init__(self) -> None:
        self.bias = 0.0
        self.w = np.zeros(WIDTH, np.float32)
        self.v = np.random.Generator(np.random.PCG64(5)).normal(0, 0.05, (WIDTH, FACTORS)).astype(np.float32)

    def _sums(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        xv = self.v[index] * value[:, None]
        total = np.add.reduceat(xv, first[:-1], 0)
        score = self.bias + np.add.reduceat(self.w[index] * value, first[:-1]) + 0.5 * (total**2 - np.add.reduceat(xv**2, first[:-1], 0)).sum(1)
        return score, total, xv

    def score(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probability of good quality; every text has its structure features, so none is empty."""
        if len(first) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self._sums(first, index, value)[0].astype(float), -30, 30)))

    def fit(self, first: np.ndarray, index: np.ndarray, value: np.ndarray, good: np.ndarray, epochs: int = EPOCHS) -> None:
        """Both classes weigh the same in all."""
        weight = np.where(good, 0.5 / max(good.mean(), 1e-6), 0.5 / max(1 - good.mean(), 1e-6))
        gw, gv, gb = np.full(WIDTH, 1e-3, np.float32), np.full((WIDTH, FACTORS), 1e-3, np.float32), 1e-3
        for epoch in range(epochs):
            order = np.random.Generator(np.random.PCG64(epoch)).permutation(len(good))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                count = first[rows + 1] - first[rows]
                take = np.repeat(first[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
                begin = np.concatenate([[0], np.cumsum(count)])
                i, x = index[take], value[take]
                score, total, xv = self._sums(begin, i, x)
                slope = (weight[rows] * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - good[rows])).astype(np.float32) / len(rows)
                each = np.repeat(slope, count)
                used, slot = np.unique(i, return_inverse=True)
                dw = np.bincount(slot, each * x, len(used)).astype(np.float32) + DECAY * self.w[used]
                grad = (each * x)[:, None] * (np.repeat(total, count, 0) - xv)
                dv = np.stack([np.bincount(slot, grad[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) + DECAY * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                gb += float(slope.sum()) ** 2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
                self.bias -= RATE * float(slope.sum()) / gb**0.5


def _with_metadata(docs: DataFrame) -> DataFrame:
    pick = lambda c: F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
    return docs.select("doc_id", pick("text"), pick("lang"), pick("source"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """A machine fitted on at most ``fit_rows`` labelled documents; without labels of both kinds it rates all alike."""
    sample = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                first, index, value = features(part.column("text"), part.column("lang"), part.column("source"))
                packed = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)) for x in (index, value)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *packed], names=["doc_id", "quality", "i", "x"])

    described = _with_metadata(docs).filter("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text", "lang", "source").mapInArrow(describe, "doc_id bigint, quality int, i array<int>, x array<float>")
    rows = described.toArrow()  # bounded by fit_rows
    machine = Machine()
    rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending")])).combine_chunks()
    good = np.asarray(rows.column("quality")) > 0
    if good.any() and not good.all():
        i = rows.column("i").combine_chunks()
        first = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(i)))])
        machine.fit(first, np.asarray(i.flatten()), np.asarray(rows.column("x").combine_chunks().flatten()), good)
    return machine


def rated(docs: DataFrame, labels: DataFrame, keep: float = KEEP, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows (doc_id, quality, keep), one for each document: the probability of good quality.

    Null and empty texts are rated by their structure and metadata alone; so
    is what lacks a language or source. Rows that repeat are rated one by one;
    other columns are ignored; an empty table gives no rows. Without labels of
    both kinds every document is kept, at 0.5 or near it.
    """
    machine = fit(docs, labels, fit_rows)

    @F.arrow_udf("double")
    def rate(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, langs, sources in batches:
            parts = [machine.score(*features(texts.slice(a, b - a), langs.slice(a, b - a), sources.slice(a, b - a))) for a, b in K.slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    found = _with_metadata(docs).select("doc_id", rate("text", "lang", "source").alias("p"))
    return found.select("doc_id", F.round("p", 6).alias("quality"), (F.col("p") >= keep).alias("keep"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return rated(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
