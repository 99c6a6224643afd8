"""Operator 1: best-fit packing of documents into fixed-capacity bins.

Hierarchical residual packing. Every scan partition packs its own documents
best-fit in decreasing order and emits the bins that are nearly full. The
underfull bins travel up a tree as indivisible items: ``fan_in`` partitions
meet in one task, are best-fit again, emit what is now nearly full, and so on
to one root. The fill that counts as nearly full falls with the level, down to
half at the root, so that what reaches a task stays bounded as the number of
partitions grows (best-fit leaves at most one bin that is half empty).

Only ids and lengths move: the text is read once, for its token count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stash

CAPACITY = 2048
FAN_IN = 8
NEARLY_FULL = 0.98
RELAX = 0.06
BLOCK = 1 << 18

_MEMBER = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())])
_BINS = pa.schema([("part", pa.int64()), ("closed", pa.bool_()), ("bin", pa.string()), ("fill", pa.int64()), ("members", pa.list_(_MEMBER))])
_DDL = "part bigint, closed boolean, bin string, fill bigint, members array<struct<doc_id:bigint,start:bigint,length:bigint,offset:bigint>>"


def best_fit(items: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Best-fit decreasing over (size, members); ties go by order of arrival, so the result depends on the input alone."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    bins: list[list] = []
    for size, members in sorted(items, key=lambda x: -x[0]):
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
            bin_ = bins[at]
        else:
            left, at, bin_ = capacity, len(bins), [0, []]
            bins.append(bin_)
        base = bin_[0]
        bin_[1].extend((d, s, n, o + base) for d, s, n, o in members)
        bin_[0] += size
        left -= size
        if left:
            room[left].append(at)
            mask |= 1 << left
    return [(fill, members) for fill, members in bins]


def _emit(part: int, tag: str, bins: list[tuple[int, list]], full: float, first: int) -> pa.RecordBatch:
    keys = ("doc_id", "start", "length", "offset")
    return pa.RecordBatch.from_pylist(
        [
            {"part": part, "closed": fill >= full, "bin": f"{tag}-{first + i}", "fill": fill, "members": [dict(zip(keys, m)) for m in members]}
            for i, (fill, members) in enumerate(bins)
        ],
        schema=_BINS,
    )


def _local(capacity: int, full: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[int, list]] = []
        part = made = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal items, made
            bins = best_fit(items, capacity)
            items = [] if last else [b for b in bins if b[0] < full]
            done = bins if last else [b for b in bins if b[0] >= full]
            for at in range(0, len(done), 20_000):
                yield _emit(part, f"0-{part}", done[at : at + 20_000], full, made)
                made += len(done[at : at + 20_000])

        for batch in batches:
            for part, doc, size in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "size"))):
                for start in range(0, size, capacity):
                    n = min(capacity, size - start)
                    items.append((n, [(doc, start, n, 0)]))
            if len(items) >= BLOCK:
                yield from flush(False)
        yield from flush(True)

    return run


def _merge(capacity: int, full: float, level: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = sorted(zip(table.column("bin").to_pylist(), table.column("fill").to_pylist(), table.column("members").to_pylist()), key=lambda r: r[0])
        items = [(fill, [(m["doc_id"], m["start"], m["length"], m["offset"]) for m in members]) for _, fill, members in rows]
        return pa.Table.from_batches([_emit(part, f"{level}-{part}", best_fit(items, capacity), full, 0)])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """Rows (bin_id, doc_id, start, length, offset, fill): tokens [start, start+length) of a document lie at ``offset`` of a bin.

    Sizes are whitespace-separated tokens. A document longer than ``capacity``
    is cut into full pieces and a remainder. Null, empty and blank texts have
    no tokens and appear in no bin. A null doc_id is packed and stays null.
    Repeated rows are packed once each. Other columns are ignored. An empty
    table gives no rows. Which documents share a bin depends on how the table
    is split into partitions; that every token has its place does not.
    """
    sized = docs.select(
        F.spark_partition_id().cast("bigint").alias("part"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\f\r]+")), F.lit(0)).cast("bigint").alias("size"),
    )
    open_ = stash(sized.mapInArrow(_local(capacity, nearly_full * capacity), _DDL), "pack0")
    tables = [open_]
    parts = (open_.filter("not closed").agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        last = parts <= fan_in
        full = 0 if last else max(0.5, nearly_full - RELAX * level) * capacity
        merged = (
            tables[-1]
            .filter("not closed")
            .withColumn("part", F.floor(F.col("part") / fan_in).cast("bigint"))
            .groupBy("part")
            .applyInArrow(_merge(capacity, full, level), _DDL)
        )
        tables.append(stash(merged, f"pack{level}"))
        parts = -(-parts // fan_in)
        if last:
            break
    closed = tables[0].filter("closed")
    for table in tables[1:]:
        closed = closed.unionByName(table.filter("closed"))
    return closed.select(F.col("bin").alias("bin_id"), "fill", F.inline("members")).select("bin_id", "doc_id", "start", "length", "offset", "fill")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
