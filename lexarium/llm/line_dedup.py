"""Operator 10: removal of lines that repeat an earlier line up to a few edits.

Segment-partition edit join. A line of b bytes allows ``tau(b)`` edits. Every
distinct line is split into tau+1 even segments, which index it by
(length, segment number, segment). Another line within the threshold keeps at
least one segment whole, so it is found by probing that index with the
substrings of each line at the positions that a match can have (the
multi-match-aware window: with a length difference D, segment i may be shifted
by i on its left and by tau-i on its right). Candidates are verified with a
banded bit-parallel edit distance over whole lines, many pairs at a time.

Where one segment is that of very many lines (``HOT_PAIRS`` pairs), its pairs
are not listed. Its lines are split again into one segment more, of which two
are then untouched, and join on two segments; what is still too many goes on
to three, and so on up to ``LEVELS``. Every pair within the threshold is found
at one of the levels.

Distances count UTF-8 bytes. ``tau`` is that of the longer line.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import fresh, spread, stash

MIN_BYTES = 24
#: Of lines of any length, so that equal short ones go too: what the query and the pipeline compare.
ALL_LINES = 1
#: Lines of at least so many bytes allow so many edits; shorter ones than the first only equal lines.
TAU = ((24, 1), (80, 2))
BROADCAST_ROWS = 1_000_000
BLOCK_CELLS = 2_000_000
HOT_PAIRS = 4_000_000
LEVELS = 4

_KEYS = "key bigint, line bigint"


def tau_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths), np.int64)
    for least, tau in TAU:
        out[lengths >= least] = tau
    return out


def _segments(length: np.ndarray, tau: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of segment i: the last length % (tau+1) segments are one longer."""
    short, more = length // (tau + 1), length % (tau + 1)
    plain = tau + 1 - more
    return i * short + np.maximum(0, i - plain), short + (i >= plain)


def _shifts(t: int, d: int, taken: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Shifts that whole segments of a line may have in one that is ``d`` bytes longer, for one or more segments in order."""
    if len(taken) == 1:  # seen from both ends, fewer are needed for one segment
        i = taken[0]
        return [(x,) for x in range(max(-i, d - (t - i)), min(i, d + t - i) + 1)]
    out = [()]
    for _ in taken:
        out = [(*x, y) for x in out for y in range(-t, t + d + 1)]
    cost = lambda x: sum(abs(b - a) for a, b in zip((0, *x), (*x, d)))
    return [x for x in out if cost(x) <= t]


def _signatures(level: int):
    """Index and probe keys of the distinct lines of a partition; the lowest bit of ``line`` tells a probe.

    At level L a line of threshold tau has tau + L segments, and a key is made of L of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            text, ids = batch.column(1), np.asarray(batch.column(0), dtype=np.int64)
            for a, b in K.slices(text):
                line, at = np.unique(ids[a:b], return_index=True)
                new = ~np.isin(line, seen, assume_unique=True)
                line, at = line[new], at[new]
                if not len(line):
                    continue
                seen = np.union1d(seen, line)
                raw, offsets = K.text_bytes(text.slice(a, b - a))
                yield from _keys(level, raw, offsets[at], offsets[at + 1] - offsets[at], line)

    return run


def _keys(level: int, raw: np.ndarray, begin: np.ndarray, length: np.ndarray, line: np.ndarray) -> Iterator[pa.RecordBatch]:
    sums = K.prefix_sums(K.BYTE_CODE[raw])
    keys, lines = [], []

    def put(which, spans, kind, probe):
        key = K.mix(kind * 8 + level)
        for n, (start, size) in enumerate(spans):
            key ^= K.mix(K.span_hash(sums, start, start + size), n) if n else K.span_hash(sums, start, start + size)
        keys.append(key)
        lines.append((line[which] & ~np.int64(1)) | probe)

    taus = tau_of(length)
    for t in sorted({t for _, t in TAU}):
        own, parts = np.flatnonzero(taus == t), t + level
        # a shorter line of a lower class is indexed for this class too
        indexed = np.concatenate([own, np.flatnonzero((taus < t) & (tau_of(length + t) >= t))])
        for code, taken in enumerate(combinations(range(parts), level)):
            size = length[indexed]
            if len(indexed):
                put(indexed, [(begin[indexed] + s, n) for s, n in (_segments(size, parts - 1, i) for i in taken)], (size * 16 + t) * 64 + code, 0)
            for d in range(t + 1):
                probing = own[length[own] - d >= np.maximum(length[own] - t, 1)]
                other = length[probing] - d
                cut = [_segments(other, parts - 1, i) for i in taken]
                for shift in _shifts(t, d, taken):
                    use = np.ones(len(probing), bool)
                    for (s, n), x in zip(cut, shift):
                        use &= (s + x >= 0) & (s + x + n <= length[probing])
                    if use.any():
                        put(probing[use], [(begin[probing[use]] + (s + x)[use], n[use]) for (s, n), x in zip(cut, shift)], (other[use] * 16 + t) * 64 + code, 1)
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(lines))], names=["key", "line"])


def _pairs_of(key: np.ndarray, line: np.ndarray, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(indexed, probe) of rows with one key, for rows sorted by key; (lines, None) where a key has more than ``most`` pairs."""
    cut = np.flatnonzero(np.diff(key)) + 1
    start = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([start, [len(key)]]))
    two = start[size == 2]
    a, b = line[two], line[two + 1]
    for x, y in ((a, b), (b, a)):
        ok = ((x & 1) == 0) & ((y & 1) == 1) & ((x ^ y) & ~np.int64(1) != 0)
        yield x[ok], y[ok] & ~np.int64(1)
    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        group = np.unique(line[s : s + n])
        probes, index = group[group & 1 == 1] & ~np.int64(1), group[group & 1 == 0]
        if most is not None and len(index) * len(probes) > most:
            yield np.union1d(index, probes), None
            continue
        step = max(1, 1_000_000 // max(1, len(probes)))
        for at in range(0, len(index), step):
            block = index[at : at + step]
            x, y = np.repeat(block, len(probes)), np.tile(probes, len(block))
            ok = x != y
            yield x[ok], y[ok]


def _join(most: int | None):
    """Candidate pairs (a, b) from rows sorted by key, which may run over several batches; (line, null) where a key has too many."""

    def told(low: np.ndarray, high: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(low), 100_000):
            a = low[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if high is None else pa.array(high[at : at + 100_000])], names=["a", "b"])

    def out(key: np.ndarray, line: np.ndarray) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for a, b in _pairs_of(key, line, most):
            if b is None:
                yield from told(a, None)
                continue
            held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            count += len(a)
            if count > 1_000_000:
                both, held, count = np.unique(np.concatenate(held), axis=0), [], 0
                yield from told(both[:, 0], both[:, 1])
        if count:
            both = np.unique(np.concatenate(held), axis=0)
            yield from told(both[:, 0], both[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        weight, passed = 0, None  # the key whose lines are passed on as they come
        for batch in batches:
            key, line = (np.asarray(batch.column(i), dtype=np.int64) for i in range(2))
            if passed is not None and len(key):
                upto = int(np.searchsorted(key, passed, "right"))
                yield from told(np.unique(line[:upto] & ~np.int64(1)), None)
                key, line = key[upto:], line[upto:]
            if not len(key):
                continue
            passed = None
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut or (held and held[0][0][0] != key[0]):
                yield from out(*(np.concatenate([*(h[i] for h in held), x[:cut]]) for i, x in enumerate((key, line))))
                held, weight = [], 0
            held.append((key[cut:], line[cut:]))
            weight += len(key) - cut
            if most is not None and weight > most:
                for _, h in held:
                    yield from told(np.unique(h & ~np.int64(1)), None)
                held, weight, passed = [], 0, key[-1]
        if held:
            yield from out(*(np.concatenate([h[i] for h in held]) for i in range(2)))

    return run


def banded_distance(a: list[bytes], b: list[bytes], tau: int) -> np.ndarray:
    """Edit distance of each pair (a[i], b[i]) where it is at most ``tau`` (under 31), else tau + 1.

    One 64-bit word holds the band of 2*tau+1 diagonals of a pair; every step
    advances all pairs by one byte (the diagonal form of the bit-vector
    recurrence of Myers, as Hyyrö gave it for bands).
    """
    swap = [len(x) < len(y) for x, y in zip(a, b)]
    long_, short = [y if s else x for x, y, s in zip(a, b, swap)], [x if s else y for x, y, s in zip(a, b, swap)]
    n = len(a)
    la, lb = np.array([len(x) for x in long_], np.int64), np.array([len(x) for x in short], np.int64)
    if not n:
        return np.zeros(0, np.int64)
    pad = 2 * tau + 2
    order = np.argsort(la, kind="stable")
    result = np.full(n, tau + 1, np.int64)
    at = 0
    while at < n:
        step = 4096
        while step > 1 and step * la[order[min(at + step, n) - 1]] > BLOCK_CELLS:
            step //= 2
        own = order[at : at + step]
        at += step
        own = own[la[own] - lb[own] <= tau]
        if not len(own):
            continue
        width = int(la[own].max())
        A = np.zeros((width + 2 * pad, len(own)), np.int16) - 1
        B = np.zeros((width + 1, len(own)), np.int16) - 2
        for i, j in enumerate(own.tolist()):
            A[pad : pad + la[j], i] = np.frombuffer(long_[j], np.uint8)
            B[: lb[j], i] = np.frombuffer(short[j], np.uint8)
        # bit d of the band stands for row j + d - tau of the long text at column j of the short one
        band = 2 * tau + 1
        full = np.uint64((1 << band) - 1)
        one = np.uint64(1)
        # before the first column only the rows from 0 on exist, each one more than the row above
        vp = np.full(len(own), ((1 << band) - 1) & ~((1 << tau) - 1), np.uint64)
        vn = np.zeros(len(own), np.uint64)
        score = np.zeros(len(own), np.int64)  # value on the main diagonal
        final = np.full(len(own), -1, np.int64)
        ends = lb[own]
        diff = la[own] - lb[own]
        diagonal = np.uint64(1 << tau)
        for j in range(int(ends.max()) if len(ends) else 0):
            x = np.zeros(len(own), np.uint64)
            for d in range(band):
                x |= (A[pad + j + d - tau] == B[j]).astype(np.uint64) << np.uint64(d)
            d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
            hp = (vn | ~(d0 | vp)) & full
            hn = d0 & vp
            live = j < ends
            score += live & ((d0 & diagonal) == 0)
            shifted = d0 >> one
            vp = (hn | ~(shifted | hp)) & full
            vn = shifted & hp
            stop = np.flatnonzero(ends == j + 1)
            if len(stop):
                value = score[stop].copy()
                for step in range(1, tau + 1):
                    more = diff[stop] >= step
                    bit = np.uint64(tau + step - 1)
                    value += more * (((vp[stop] >> bit) & one).astype(np.int64) - ((vn[stop] >> bit) & one).astype(np.int64))
                final[stop] = value
        empty = ends == 0
        final[empty] = la[own][empty]
        result[own] = np.minimum(final, tau + 1)
    return result


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("ta", "tb"))
        longest = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
        taus = tau_of(longest)
        distance = np.zeros(len(a), np.int64)
        for t in np.unique(taus).tolist():
            own = np.flatnonzero(taus == t)
            distance[own] = banded_distance([a[i] for i in own], [b[i] for i in own], t)
        ok = pa.array(distance <= taus)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(ok) for c in ("a", "b", "ha", "hb")), pa.array(distance).filter(ok)], names=["a", "b", "ha", "hb", "distance"])


def _lines(docs: DataFrame, least: int) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "line"))
    return lines.filter((F.octet_length("line") >= least) & ((F.octet_length("line") >= MIN_BYTES) | F.col("line").rlike(r"\S")))


def _line_id(line: Column | str) -> Column:
    return F.xxhash64(line).bitwiseAND(F.lit(~1)).alias("id")


def _check(line: Column | str) -> Column:
    """A second hash: lines count as equal only where both are."""
    return F.hash(line).alias("check")


def near_lines(docs: DataFrame, least: int = MIN_BYTES, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Rows (a, b, ha, hb, distance): ids and second hashes of distinct lines within the threshold of each other, each pair once, a < b."""
    least = max(least, MIN_BYTES - TAU[0][1])  # shorter ones are within no threshold of another line
    texts = _lines(docs, least).select(_line_id("line"), "line")
    lines, found = texts, []
    for level in range(1, LEVELS + 1):
        signed = lines.mapInArrow(_signatures(level), _KEYS)
        joined = signed.repartition("key").sortWithinPartitions("key").mapInArrow(_join(hot_pairs if level < LEVELS else None), "a bigint, b bigint")
        joined = stash(joined.distinct(), "linepairs")
        found.append(joined.filter("b is not null"))
        hot = joined.filter("b is null").select(F.col("a").alias("id"))
        if level == LEVELS or hot.isEmpty():
            break
        lines = texts.join(hot, "id", "left_semi")
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.union(more)
    candidates = candidates.distinct() if len(found) > 1 else candidates
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if candidates.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(wanted), "id", "left_semi")
    else:
        texts = texts.join(wanted, "id", "left_semi")
    texts = texts.groupBy("id").agg(F.min("line").alias("line")).select("id", "line", _check("line"))
    side = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"t{x}"), F.col("check").alias(f"h{x}"))
    both = candidates.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "ha", "hb", "ta", "tb").mapInArrow(_verify, "a bigint, b bigint, ha int, hb int, distance bigint")


def _duplicates(docs: DataFrame, least: int) -> DataFrame:
    """As :func:`duplicate_lines`, with the id of the line: rows of one doc_id may differ in text."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    at = _lines(docs, least).select(_line_id("line"), _check("line"), F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no")).alias("at"))
    near = stash(near_lines(docs, least), "nearlines")
    first = at.groupBy("id", "check").agg(F.min("at").alias("first"))
    links = near.select("a", "ha", "b", "hb").union(near.select("b", "hb", "a", "ha")).toDF("id", "check", "b", "hb")
    pulled = links.join(first.select(F.col("id").alias("b"), F.col("check").alias("hb"), "first"), ["b", "hb"]).groupBy("id", "check").agg(F.min("first").alias("near"))
    known = first.join(pulled, ["id", "check"], "left").select("id", "check", F.least("first", "near").alias("first"))
    every = at.join(known, ["id", "check"]).filter("at > first")
    return every.select("at.doc_id", "at.line_no", F.col("first.doc_id").alias("of_doc_id"), F.col("first.line_no").alias("of_line_no"), "id").distinct()


def duplicate_lines(docs: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """Rows (doc_id, line_no, of_doc_id, of_line_no): lines with an earlier line within the threshold, and the earliest such.

    Lines are the parts of a text between newlines, numbered from 0; earlier
    means less by (doc_id, line_no). A line goes if any earlier line is equal
    or near, whether that one stays or not. Lines under ``least`` bytes
    and blank ones under ``MIN_BYTES`` are never compared; those under ``MIN_BYTES`` go where they
    are equal, or within the threshold of a longer line. Null and empty texts have no such lines; rows whose
    doc_id is null are left out. Of rows with equal doc_id and text the lines
    count as one (same position). Other columns are ignored; an empty table
    gives no rows.
    """
    return _duplicates(docs, least).drop("id").distinct()


def drop_lines(docs: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """The documents without their duplicate lines; one that loses lines and has nothing left but white space goes.

    Columns stay as they are, but for text and n_chars (where there is one).
    Rows without doc_id or text stay as they are, rows that repeat doc_id and
    text are cut alike, and an empty table stays empty.
    """
    key, marks = fresh(docs, "key"), fresh(docs, "gone")
    gone = _duplicates(docs, least).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("line_no", "id")).alias(marks))
    joined = docs.join(gone, docs["doc_id"].cast("bigint") == gone[key], "left").drop(key)
    mark = lambda line, i: F.struct(i.cast("bigint").alias("line_no"), _line_id(line))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col(marks), mark(line, i))), "\n")
    joined = joined.withColumn("text", F.when(F.col(marks).isNull(), F.col("text")).otherwise(kept))
    joined = joined.filter(F.col(marks).isNull() | F.col("text").isNull() | F.col("text").rlike(r"\S")).drop(marks)
    return joined.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else joined


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_lines(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), ALL_LINES)


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents
), k AS (
  SELECT line, strlen(line) AS n, min((doc_id, line_no)) AS f FROM l WHERE strlen(line) >= 24 OR regexp_matches(line, '\S') GROUP BY ALL
), p AS (
  SELECT a.line, least(min(b.f), any_value(a.f)) AS f
  FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) + n AS m FROM k WHERE n >= 23) a JOIN k b ON a.m = b.n
  WHERE a.line <> b.line AND levenshtein(a.line, b.line) <= CASE WHEN greatest(a.n, b.n) >= 80 THEN 2 WHEN greatest(a.n, b.n) >= 24 THEN 1 ELSE 0 END
  GROUP BY 1
), z AS (SELECT line, coalesce(p.f, k.f) AS f FROM k LEFT JOIN p USING (line))
SELECT DISTINCT doc_id, line_no::BIGINT AS line_no, f[1] AS of_doc_id, f[2]::BIGINT AS of_line_no FROM l JOIN z USING (line) WHERE (doc_id, line_no) > f
"""
