"""Operator 8: removal of passages of ``WINDOW`` tokens or more that repeat.

Depth-limited radix sort of the suffixes, most significant digit first. A
suffix takes part up to its first ``WINDOW`` tokens; its digits are runs of
tokens, and ``DEPTHS`` tells how many tokens are sorted after each pass. A
pass parts every group of the pass before by the next digit; groups of one are
done and take no part any more. Groups that are left after the last pass are
exactly the repeated windows.

In a pass, tasks scan the texts, take the suffixes that are still in a group
and send the key of their tokens so far to the bucket of its leading bits, in
blocks. A key stands once in a block however often its texts repeat there, so
copies are joined before the shuffle and no group is larger than the number
of blocks. The answer for a block is a bit for each key, and goes back to the
scan partition it came from (:mod:`.parts`). Keys of early passes are 40 bits
and the bucket; where two digits share one, a later pass parts them. The last
pass compares 96 bits and the bucket, of two independent hashes, and also
carries the first place of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import parts
from .store import spread, stash

WINDOW = 50
#: Tokens sorted after each pass; the last is the window.
DEPTHS = (16, 32, 50)
#: A block of the texts of this many bytes is sent at a time, or up to so many where buckets would get too few keys of it.
BLOCK_BYTES, MOST_BLOCK_BYTES = 1 << 20, 32 << 20
KEYS_A_BUCKET = 64
BUCKETS_A_PARTITION = 16

_SENT = "bucket bigint, part int, block int, n int, base bigint, data binary"
_BACK = "part int, block int, bucket bigint, n int, data binary"
_BACK_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings cut out of one array of bytes at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _columns(n: np.ndarray, *fields: np.ndarray) -> pa.Array:
    """For runs of ``n`` rows one byte string each: the bytes of all rows of the first field, then of the second, and so on."""
    ends = np.cumsum(n)
    out, at = np.zeros(int(ends[-1]) * sum(f.shape[1] for f in fields) if len(n) else 0, np.uint8), np.zeros(len(n), np.int64)
    size = n * sum(f.shape[1] for f in fields)
    begin = np.cumsum(size) - size
    row = np.arange(int(ends[-1]) if len(n) else 0)
    run = np.repeat(np.arange(len(n)), n)
    for f in fields:
        place = (begin + at)[run] + (row - (ends - n)[run]) * f.shape[1]
        out[place[:, None] + np.arange(f.shape[1])] = f
        at += n * f.shape[1]
    return _binary(out, np.cumsum(size))


def _fields(data: pa.Array, n: np.ndarray, *widths: int) -> list[np.ndarray]:
    """What :func:`_columns` packed, one array (rows, width) for each field."""
    raw, offsets = K.text_bytes(data.cast(pa.large_binary()).view(pa.large_string()))
    run = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    out, at = [], np.zeros(len(n), np.int64)
    for w in widths:
        out.append(raw[((offsets[:-1] + at)[run] + within * w)[:, None] + np.arange(w)])
        at += n * w
    return out


def _bytes(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width]


def _number(x: np.ndarray) -> np.ndarray:
    full = np.zeros((len(x), 8), np.uint8)
    full[:, : x.shape[1]] = x
    return full.view(np.uint64).ravel()


class _Sorter:
    """The passes seen from a scan: which suffixes of a block are still in a group, and by what keys."""

    def __init__(self, depths: tuple[int, ...], buckets: int, answers: list[tuple], block_bytes: int):
        self.depths, self.buckets, self.block_bytes = depths, buckets, block_bytes
        self.part = TaskContext.get().partitionId()
        self.bits = []
        for where in answers:
            table = parts.get(where, self.part, _BACK_ARROW).sort_by([("block", "ascending"), ("bucket", "ascending")])
            block, column = np.asarray(table.column("block")), table.column("data").combine_chunks()
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            self.bits.append({int(block[a]): (np.asarray(table.column("n"))[a:b], column.slice(a, b - a)) for a, b in zip(cut, np.append(cut[1:], len(block)))})

    def suffixes(self, column: pa.Array, window: int, levels: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(keys, row, place) of all suffixes of a block: their keys up to each level, from a little text at a time."""
        keys: list[list[np.ndarray]] = [[] for _ in range(levels)]
        rows, places = [], []
        for a, b in K.slices(column):
            tokens, start, first = _suffixes(column.slice(a, b - a), window)
            owner = np.searchsorted(first, start, "right") - 1
            rows.append((owner + a).astype(np.int32))
            places.append((start - first[owner]).astype(np.int32))
            sums = K.prefix_sums(tokens)
            for level in range(levels):
                # beyond the last level, which is the whole window, comes its second hash
                if level < len(self.depths):
                    keys[level].append(K.span_hash(sums, start, start + self.depths[level]))
                else:
                    keys[level].append(_second(tokens, start, window))
        joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return [joined(k, np.uint64) for k in keys], joined(rows, np.int32), joined(places, np.int32)

    def known(self, level: int, number: int, keys: int) -> tuple[np.ndarray, pa.Array]:
        """Numbers of keys and answers of the buckets of a block, in order."""
        n, data = self.bits[level].get(number, (np.zeros(0, np.int32), pa.array([], pa.binary())))
        if n.sum() != keys:
            raise parts.Moved
        return n, data

    def left(self, number: int, keys: list[np.ndarray], levels: int) -> np.ndarray:
        """Of the suffixes with these keys those that are in a group after so many passes."""
        at = np.arange(len(keys[0]))
        for level in range(levels):
            key, back = np.unique(keys[level][at], return_inverse=True)
            n, data = self.known(level, number, len(key))
            if not len(key):
                break
            raw, offsets = K.text_bytes(data.cast(pa.large_binary()).view(pa.large_string()))
            bit = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            held = (raw[np.repeat(offsets[:-1], n) + bit // 8] >> (bit % 8).astype(np.uint8)) & 1
            at = at[held[back] == 1]
        return at


def _suffixes(column: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, start, first): hashes of all tokens, and the numbers of those where a window begins."""
    tokens, first = K.token_hashes(column)
    count = np.maximum(np.diff(first) - window + 1, 0)
    start = np.arange(count.sum()) + np.repeat(first[:-1] - np.cumsum(count) + count, count)
    return tokens, start, first


def _texts(batch: pa.RecordBatch) -> pa.Array:
    """Texts of the rows that have a doc_id; the others count as empty."""
    return pc.if_else(pc.is_valid(batch.column("doc_id")), batch.column("text"), "")


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key."""
    return ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _second(tokens: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    return K.span_hash(K.prefix_sums(K.mix(tokens, 31)), start, start + window)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of the runs of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(x)))


def _first_places(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, suffix of the first place, times, number of the key of each suffix): first by document and place in it."""
    order = np.lexsort((at, doc, key))
    begin, times = _runs(key[order])
    back = np.empty(len(key), np.int64)
    back[order] = np.repeat(np.arange(len(begin)), times)
    return key[order][begin], order[begin], times, back


def _send(sorter_of, level: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter: _Sorter = sorter_of()
        final = level == len(sorter.depths) - 1
        number = 0
        for batch in batches:
            column, ids = _texts(batch), batch.column("doc_id").fill_null(0)
            for a, b in K.slices(column, sorter.block_bytes):
                keys, row, place = sorter.suffixes(column.slice(a, b - a), window, level + 1 + final)
                at = sorter.left(number, keys, level)
                number += 1
                if not len(at):
                    continue
                key = keys[level][at]
                if final:
                    doc, place = np.asarray(ids.slice(a, b - a).cast(pa.int64()))[row[at]], place[at]
                    key, rep, times, _ = _first_places(key, doc, place)
                else:
                    key, times = np.unique(key, return_counts=True)
                bucket = _bucket(key, sorter.buckets)
                begin, n = _runs(bucket)
                many = (times > 1).astype(np.uint8)[:, None]
                base = 0
                if final:
                    base = int(doc.min())
                    near = doc[rep] - base
                    packed = _columns(n, _bytes(key, 8), _bytes(keys[level + 1][at][rep], 4), many, _bytes(near, 8), _bytes(place[rep], 4))
                else:
                    packed = _columns(n, _bytes(key, 5), many)
                k = len(begin)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(np.full(k, sorter.part, np.int32)), pa.array(np.full(k, number - 1, np.int32)), pa.array(n.astype(np.int32)), pa.array(np.full(k, base)), packed], names=["bucket", "part", "block", "n", "base", "data"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by bucket, whole buckets at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = np.asarray(batch.column("bucket"))
        cut = int(np.searchsorted(bucket, bucket[-1], "left"))
        if cut or (held and held[0].column("bucket")[0].as_py() != bucket[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _answer(table: pa.Table, data: pa.Array) -> Iterator[pa.RecordBatch]:
    for batch in pa.table([*(table.column(c) for c in ("part", "block", "bucket", "n")), data], ["part", "block", "bucket", "n", "data"]).to_batches(10_000):
        yield batch


def _bits(flag: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each run): flags packed to bits, every run from a new byte on."""
    size = (n + 7) // 8
    place = np.repeat((np.cumsum(size) - size) * 8 - (np.cumsum(n) - n), n) + np.arange(len(flag))
    wide = np.zeros(int(size.sum()) * 8, np.uint8)
    wide[place] = flag
    return np.packbits(wide, bitorder="little"), size


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An early pass: whether a key has more than one suffix."""
    for table in _buckets(batches):
        n = np.asarray(table.column("n"), np.int64)
        key, many = _fields(table.column("data").combine_chunks(), n, 5, 1)
        key = (np.repeat(np.asarray(table.column("bucket")).astype(np.uint64), n) << np.uint64(40)) | _number(key)
        order = np.argsort(key)
        begin, size = _runs(key[order])
        group = np.logical_or.reduceat(many[order, 0] > 0, begin) | (size > 1)
        flag = np.empty(len(key), np.uint8)
        flag[order] = np.repeat(group, size)
        data, width = _bits(flag, n)
        yield from _answer(table, _binary(data, np.cumsum(width)))


def _judge_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last pass: 0 for a window that is alone, 1 where the block has its first place, 2 and the document of that place else."""
    for table in _buckets(batches):
        n = np.asarray(table.column("n"), np.int64)
        key, more, many, near, at = _fields(table.column("data").combine_chunks(), n, 8, 4, 1, 8, 4)
        key, more, at = _number(key), _number(more), _number(at)
        doc = _number(near).view(np.int64) + np.repeat(np.asarray(table.column("base")), n)
        order = np.lexsort((at, doc, more, key))
        changed = (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])
        begin = np.flatnonzero(np.concatenate([[True], changed]))
        size = np.diff(np.append(begin, len(key)))
        group = np.logical_or.reduceat(many[order, 0] > 0, begin) | (size > 1)
        lead = np.repeat(order[begin], size)
        state, of = np.zeros(len(key), np.uint8), np.zeros(len(key), np.int64)
        holds = (doc[order] == doc[lead]) & (at[order] == at[lead])
        state[order] = np.where(np.repeat(group, size), np.where(holds, 1, 2), 0)
        of[order] = doc[lead]
        run = np.repeat(np.arange(len(n)), n)
        extra = np.bincount(run[state == 2], minlength=len(n))
        begin, out = np.cumsum(n + 8 * extra) - (n + 8 * extra), np.zeros(int((n + 8 * extra).sum()), np.uint8)
        out[begin[run] + np.arange(len(run)) - (np.cumsum(n) - n)[run]] = state
        told = run[state == 2]
        within = np.arange(len(told)) - (np.cumsum(extra) - extra)[told]
        out[((begin + n)[told] + 8 * within)[:, None] + np.arange(8)] = _bytes(of[state == 2], 8)
        yield from _answer(table, _binary(out, np.cumsum(n + 8 * extra)))


def _spans_of(sorter: _Sorter, number: int, column: pa.Array, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, of_doc_id) of the spans covered by windows that occur earlier, by row and place."""
    level = len(sorter.depths) - 1
    keys, owner, place = sorter.suffixes(column, window, level + 1)
    left = sorter.left(number, keys, level)
    owner, at = owner[left], place[left]
    doc = ids[owner]
    key, rep, _, back = _first_places(keys[level][left], doc, at)
    n, data = sorter.known(level, number, len(key))
    none = np.zeros(0, np.int64)
    if not len(key):
        return none, none, none, none
    raw, offsets = K.text_bytes(data.cast(pa.large_binary()).view(pa.large_string()))
    run = np.repeat(np.arange(len(n)), n)
    state = raw[offsets[:-1][run] + np.arange(len(run)) - (np.cumsum(n) - n)[run]]
    of = doc[rep].copy()
    told = run[state == 2]
    extra = np.bincount(told, minlength=len(n))
    within = np.arange(len(told)) - (np.cumsum(extra) - extra)[told]
    of[state == 2] = _number(raw[((offsets[:-1] + n)[told] + 8 * within)[:, None] + np.arange(8)]).view(np.int64)
    state, of, lead = state[back], of[back], rep[back]
    again = (state == 2) | ((state == 1) & ((doc != doc[lead]) | (at != at[lead])))
    row, at, of = owner[again].astype(np.int64), at[again].astype(np.int64), of[again]
    if not len(row):
        return none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + window)]))
    return row[new], at[new], at[np.append(new[1:], len(row)) - 1] + window, np.minimum.reduceat(of, new)


def _sorted(docs: DataFrame, window: int, depths: tuple[int, ...], block_bytes: int):
    """Runs all passes over a scan; returns what makes a :class:`_Sorter` that knows the result."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_A_PARTITION * partitions
    block_bytes = max(block_bytes, min(6 * KEYS_A_BUCKET * buckets, MOST_BLOCK_BYTES))
    texts = docs.select("doc_id", "text")
    answers: list[tuple] = []

    def sorter_of(known: tuple[tuple, ...]):
        return lambda: _Sorter(depths, buckets, list(known), block_bytes)

    for level in range(len(depths)):
        sent = texts.mapInArrow(_send(sorter_of(tuple(answers)), level, window), _SENT)
        judge = _judge_last if level == len(depths) - 1 else _judge
        # buckets hold about as many keys each, so they are dealt out in turn, not by another hash
        dealt = sent.repartitionById(partitions, F.expr(f"cast(pmod(bucket, {partitions}) as int)")).sortWithinPartitions("bucket")
        answers.append(parts.put(dealt.mapInArrow(judge, _BACK), f"suffixes-{level}"))
    return sorter_of(tuple(answers))


def _depths(window: int, depths: tuple[int, ...]) -> tuple[int, ...]:
    return (*(d for d in depths if d < window), window)


def repeated_spans(docs: DataFrame, window: int = WINDOW, depths: tuple[int, ...] = DEPTHS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, start, end, of_doc_id): the token spans [start, end) covered by windows that occur earlier.

    Tokens are parted by white space. A window is ``window`` tokens in a row;
    of equal windows the first by (doc_id, position) stays and all others
    count, also inside one document and where they overlap. Spans that meet or
    overlap are one; ``of_doc_id`` is the least document that its windows
    occur in first. Null, empty and shorter texts have no windows; rows
    without doc_id are left out; rows that repeat doc_id and text count once
    (same position), those of one doc_id with other texts have the spans of
    all of them. Other columns are ignored; an empty table gives no rows.
    """
    docs = parts.as_scan(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "suffix-texts")

    def make() -> DataFrame:
        sorter_of = _sorted(docs, window, _depths(window, depths), block_bytes)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sorter, number = sorter_of(), 0
            for batch in batches:
                column, ids = _texts(batch), np.asarray(batch.column("doc_id").fill_null(0).cast(pa.int64()))
                for a, b in K.slices(column, sorter.block_bytes):
                    row, start, end, of = _spans_of(sorter, number, column.slice(a, b - a), ids[a:b], window)
                    number += 1
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a:b][row], start, end, of)], names=["doc_id", "start", "end", "of_doc_id"])

        return stash(docs.mapInArrow(find, "doc_id bigint, start bigint, end bigint, of_doc_id bigint"), "spans")

    spans = parts.settled(make)
    # rows of one doc_id: their spans are joined where they meet
    by = "partition by doc_id order by start, end"
    ended = spans.withColumn("reach", F.expr(f"max(end) over ({by} rows between unbounded preceding and 1 preceding)"))
    island = ended.withColumn("island", F.expr(f"sum(case when reach is null or start > reach then 1 else 0 end) over ({by} rows unbounded preceding)"))
    return island.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("of_doc_id").alias("of_doc_id")).drop("island")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the tokens of the spans and the white space after them."""
    raw = text.encode()
    starts, _, _ = K.token_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    at = np.append(starts, len(raw)).tolist()
    kept, last = [], 0
    for start, end in spans:
        kept.append(raw[last : at[start]])
        last = at[end]
    return b"".join([*kept, raw[last:]]).decode()


def drop_spans(docs: DataFrame, window: int = WINDOW, depths: tuple[int, ...] = DEPTHS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without their repeated spans; one that loses a span and keeps no token goes.

    A span goes with the white space after its tokens. Columns stay as they
    are, but for text and n_chars (where there is one). A row is cut by the
    spans of its own text; rows that repeat doc_id and text are cut alike.
    Rows without doc_id or text stay, and an empty table stays empty.
    """
    docs = parts.as_scan(docs, "suffix-documents")

    def make() -> DataFrame:
        sorter_of = _sorted(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), window, _depths(window, depths), block_bytes)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sorter, number = sorter_of(), 0
            for batch in batches:
                names = batch.schema.names
                column, ids = _texts(batch), np.asarray(batch.column("doc_id").fill_null(0).cast(pa.int64()))
                for a, b in K.slices(column, sorter.block_bytes):
                    part = batch.slice(a, b - a)
                    row, start, end, _ = _spans_of(sorter, number, column.slice(a, b - a), ids[a:b], window)
                    number += 1
                    if not len(row):
                        yield part
                        continue
                    begin, n = _runs(row)
                    whole = part.column("text").take(pa.array(row[begin])).to_pylist()
                    left = [cut_spans(t, list(zip(start[i : i + k].tolist(), end[i : i + k].tolist()))) for t, i, k in zip(whole, begin.tolist(), n.tolist())]
                    changed, gone = np.zeros(len(part), bool), np.zeros(len(part), bool)
                    changed[row[begin]] = True
                    gone[row[begin]] = [not t.strip(" \t\n\f\r") for t in left]
                    columns = dict(zip(names, part.columns))
                    columns["text"] = pc.replace_with_mask(columns["text"], pa.array(changed), pa.array(left, columns["text"].type))
                    if "n_chars" in columns:
                        columns["n_chars"] = pc.if_else(pa.array(changed), pc.utf8_length(columns["text"]).cast(columns["n_chars"].type), columns["n_chars"])
                    yield pa.RecordBatch.from_arrays([columns[c] for c in names], schema=part.schema).filter(pa.array(~gone))

        return stash(docs.mapInArrow(cut, docs.schema), "suffix-cut")

    return parts.settled(make)


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP8_SQL = r"""
WITH t AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT doc_id, unnest(range(0, len(w) - 49)) AS p, w FROM t WHERE len(w) >= 50
), h AS (SELECT doc_id, p, sha256(array_to_string(w[p + 1:p + 50], ' ')) AS k FROM s
), f AS (SELECT k, min((doc_id, p)) AS f FROM h GROUP BY k HAVING count(*) > 1
), r AS (
  SELECT doc_id, p, f[1] AS of_doc, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new
  FROM h JOIN f USING (k) WHERE (doc_id, p) > f
), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM r)
SELECT doc_id, min(p) AS start, max(p) + 50 AS "end", min(of_doc) AS of_doc_id FROM g GROUP BY doc_id, island
"""
