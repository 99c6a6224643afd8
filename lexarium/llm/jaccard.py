"""Operator 4: n-gram Jaccard join of documents.

Prefix join, which leaves no pair out. A document is the set of its token
bigrams, put in one order for all documents, rare ones first. Sets of ``m`` and
``n`` bigrams with a Jaccard index of at least ``t`` share at least
``t/(1+t) * (m+n)`` of them, say ``s``; the first ``k`` of the shared ones then
lie in the first ``m-s+k`` and ``n-s+k`` bigrams of the sets. So these prefixes
of the two have at least ``k`` bigrams in common (:func:`needed`, or ``s`` if that
is less), and pairs that have fewer go. Each bigram of a prefix is a key under
which the documents that have it meet; shared ones are counted by the ends of
runs that follow each other in both sets, not one by one. Every pair that is
left is verified on the whole sets.

The order follows counts and then hashes. Bigrams that a bounded sample
(``SAMPLE_TEXTS`` texts of ``SAMPLE_CHARS`` characters) has at least ``KNOWN``
times come last, by their counts in it. Scan partitions ask for the counts of
all others over the whole table: two to three bytes of a bigram go to a bucket,
and its count comes back as a class. Such counts are never too low, and all that
ask for a bigram get one answer, so the order is the same for all documents. It
decides how many documents meet, never which pairs are found. A bigram that no
other set has is no key, and a set with too few others in its prefix has none.
Keys are shuffled packed, by bucket.

Documents with equal sets are one node of the join; one scan partition passes a
set on, once (:func:`_blocks`), so copies are joined before the shuffle.
Verification moves each text once for every tile of up to ``TILE`` x ``TILE``
documents, not once a pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import parts
from .store import fresh, spread, stash

N = 2
THRESHOLD = 0.6
NEED = 4
SAMPLE_TEXTS = 10_000
SAMPLE_CHARS = 20_000
SLOT_BITS = 24
KNOWN = 2
HOT = 8
ASKED_BITS = 24
BLOCK_GRAMS = 1_000_000
SKETCHED = 64
HELD_KEYS = 250_000
PAIRS = 150_000
TILE = 512
BROADCAST_ROWS = 1_000_000


def gram_sets(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct n-grams of each text in order; a text of fewer tokens is one gram, one of none has none."""
    tokens, first = K.token_hashes(column)
    grams, owner, _ = K.ngram_hashes(tokens, first, n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = K.span_hash(K.prefix_sums(tokens), first[short], first[short + 1])
        grams, owner = np.concatenate([grams, K.mix(whole, 7)]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(len(column) + 1))


def fingerprints(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for each set."""
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(K.mix(grams, 11), out=sums[1:])
    return K.mix((sums[first[1:]] - sums[first[:-1]]) ^ np.diff(first).astype(np.uint64), 13).view(np.int64)


def least_shared(m: np.ndarray, n: np.ndarray, t: float) -> np.ndarray:
    """How many bigrams sets of ``m`` and ``n`` share at least if their index is ``t`` or more."""
    return np.ceil(t / (1 + t) * (np.asarray(m, float) + n) - 1e-6).astype(np.int64)


def needed(n: np.ndarray) -> np.ndarray:
    """How many shared bigrams a set of ``n`` counts on in prefixes; long sets have a few by chance."""
    return NEED + np.asarray(n) // 64


def prefix_length(n: np.ndarray, t: float = THRESHOLD) -> np.ndarray:
    """How many of its ``n`` bigrams, rarest first, a set meets others by."""
    return np.minimum(n, n - np.ceil(t * np.asarray(n, float) - 2e-6).astype(np.int64) + needed(n))


def least_recall(n: int, t: float = THRESHOLD) -> float:
    """The least share of the sets with an index of at least ``t`` to one of ``n`` bigrams that meet it: 1 if its prefix holds what any such pair counts on."""
    other = np.arange(max(1, int(np.ceil(t * n - 1e-6))), int(n / t + 1e-6) + 1)
    shared = least_shared(np.full(len(other), n), other, t)
    need = np.minimum(needed(np.minimum(n, other)), shared)
    return float(((n - shared + need <= prefix_length(n, t)) & (other - shared + need <= prefix_length(other, t))).mean())


def slots(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def least_needed(n: np.ndarray, t: float = THRESHOLD) -> np.ndarray:
    """The fewest shared bigrams that a set of ``n`` has in its prefix with any set that reaches ``t``."""
    other = np.maximum(1, np.ceil(t * np.asarray(n, float) - 2e-6)).astype(np.int64)
    return np.minimum(needed(other), least_shared(n, other, t))


def signatures(grams: np.ndarray, first: np.ndarray, t: float = THRESHOLD, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, owner, place, sketch) of every bigram of the prefixes.

    ``rank`` has the place of each bigram in the order of all, 1 for those that
    no other set has; these are no keys, and neither are any of a set that has
    too few others. ``place`` has columns for the position in the order, the key
    before and the key behind. The bits of ``sketch`` are flipped by the bigrams
    of the whole set, so two differ in no more bits than the sets in bigrams;
    sets of over ``SKETCHED`` have none.
    """
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    code = K.mix(grams, 17)
    order = np.argsort(code)
    if rank is not None:
        order = order[np.argsort(rank[order], kind="stable")]
    order = order[np.argsort(owner[order], kind="stable")]
    sketch = np.zeros((len(size), 1), np.uint64)
    held = np.flatnonzero(size)
    if len(held):
        sketch[held, 0] = np.bitwise_xor.reduceat(np.uint64(1) << (code & np.uint64(63)), first[:-1][held])
        sketch[size > SKETCHED] = 0
    code = code[order]
    position = np.arange(len(code)) - first[:-1][owner]
    around = np.concatenate([[0], code, [0]]).astype(np.uint64)
    at = np.flatnonzero(position < prefix_length(size, t)[owner])
    if rank is not None:
        at = at[rank[order[at]] > 1]
        at = at[(np.bincount(owner[at], minlength=len(size)) >= least_needed(size, t))[owner[at]]]
    place = np.stack([position[at].astype(np.uint64), around[at], around[at + 2]], 1)
    return code[at], owner[at], place, sketch[owner[at]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SLOT_BITS, np.uint32)
    for batch in batches:
        for a, b in K.slices(batch.column(0)):
            grams, _ = gram_sets(batch.column(0).slice(a, b - a))
            np.add.at(counts, slots(K.mix(grams, 17)), np.uint32(1))
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)], pa.binary())], names=["counts"])


def sampled_counts(docs: DataFrame) -> bytes:
    """Bigrams by slot in a sample of the texts, up to 255 each, compressed."""
    share = min(1.0, SAMPLE_TEXTS / max(1, docs.select("doc_id").count()))
    texts = docs.filter("text is not null").select(F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    return bytes(texts.sample(share, 1).repartition(1).mapInArrow(_counted, "counts binary").collect()[0][0])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in K.slices(batch.column(1)):
            grams, first = gram_sets(batch.column(1).slice(a, b - a))
            ok = np.diff(first) > 0
            part = np.full(ok.sum(), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(pa.array(ok)), pa.array(fingerprints(grams, first)[ok]), pa.array(part)], names=["doc_id", "fp", "part"])


_FP = pa.schema([("fp", pa.int64())])
_ASKED = "bucket bigint, part int, block int, data binary"
_ANSWER = "part int, block int, bucket bigint, check bigint, data binary"
_ANSWERS = pa.schema([("block", pa.int32()), ("bucket", pa.int64()), ("check", pa.int64()), ("data", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch], owners: tuple) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(grams, first, fp) of the sets that this scan partition is to pass on, each once, in blocks of lists."""
    owned = np.sort(np.asarray(parts.get(owners, TaskContext.get().partitionId(), _FP).column("fp")))
    left = np.ones(len(owned), bool)
    block, held = [], 0
    for batch in batches:
        for a, b in K.slices(batch.column(0)):
            if not len(owned):
                continue
            grams, first = gram_sets(batch.column(0).slice(a, b - a))
            fp, size = fingerprints(grams, first), np.diff(first)
            at = np.minimum(np.searchsorted(owned, fp), len(owned) - 1)
            new = np.flatnonzero((owned[at] == fp) & left[at])
            new = np.sort(new[np.unique(at[new], return_index=True)[1]])
            left[at[new]] = False
            take = np.zeros(len(fp), bool)
            take[new] = True
            block.append((grams[np.repeat(take, size)], np.concatenate([[0], np.cumsum(size[new])]), fp[new]))
            held += int(size[new].sum())
            if held >= BLOCK_GRAMS:
                yield block
                block, held = [], 0
    if block:
        yield block
    if left.any():
        raise parts.Moved


def _questions(code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(order, bucket, packed): the bigrams to ask for, by bucket; of each ``ASKED_BITS`` bits go beside the bucket, ascending."""
    bucket = ((code >> np.uint64(24)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)
    whole = bucket << np.uint64(ASKED_BITS) | code & np.uint64((1 << ASKED_BITS) - 1)
    order = np.argsort(whole)
    whole = whole[order]
    bucket = (whole >> np.uint64(ASKED_BITS)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    low, high = whole.astype(np.uint16), (whole >> np.uint64(16)).astype(np.uint8)
    return order, bucket[start], [low[i:j].tobytes() + high[i:j].tobytes() for i, j in zip(start.tolist(), [*start[1:].tolist(), len(bucket)])]


def _asked(block: list[tuple[np.ndarray, np.ndarray, np.ndarray]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, code): counts of the sample for the bigrams of a block, and the codes of those that it has hardly seen."""
    code = K.mix(np.concatenate([g for g, _, _ in block]), 17)
    known = table[slots(code)]
    return known, code[known < KNOWN]


def _ask(owners: tuple, counts: bytes, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(counts), np.uint8)
        part = TaskContext.get().partitionId()
        for number, block in enumerate(_blocks(batches, owners)):
            _, bucket, packed = _questions(_asked(block, table)[1], buckets)
            one = np.ones(len(bucket), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(one * part, pa.int32()), pa.array(one * number, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "part", "block", "data"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; for every bigram 1 if it was asked for once, else 1 and the logarithm of the times."""

    def out(bucket: int, held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        codes = []
        for _, _, data in held:
            n = len(data) // 3
            codes.append(np.frombuffer(data, np.uint16, n).astype(np.uint32) | np.frombuffer(data, np.uint8, n, 2 * n).astype(np.uint32) << np.uint32(16))
        code, back, times = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        answer = np.minimum(15, 1 + np.ceil(np.log2(times))).astype(np.uint8)[back]
        ends = np.cumsum([len(c) for c in codes]).tolist()
        for at in range(0, len(held), 1000):
            some = range(at, min(at + 1000, len(held)))
            packed = [zlib.compress(answer[ends[i] - len(codes[i]) : ends[i]].tobytes(), 1) for i in some]
            part, block = ([held[i][k] for i in some] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int32()), pa.array([bucket] * len(some)), pa.array([zlib.crc32(held[i][2]) for i in some], pa.int64()), pa.array(packed, pa.binary())], names=["part", "block", "bucket", "check", "data"])

    bucket, held = None, []
    for batch in batches:
        for number, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if number != bucket:
                if held:
                    yield from out(bucket, held)
                bucket, held = number, []
            held.append(tuple(row))
    if held:
        yield from out(bucket, held)


#: columns of the rows of a bucket, each packed in two-byte planes, so that what repeats or is 0 takes no room
_PACKED = {"key": 3, "before": 2, "behind": 3, "fp": 4, "sketch": 4, "n": 2, "position": 2}


def pack(columns: dict[str, np.ndarray]) -> bytes:
    out = []
    for name, planes in _PACKED.items():
        column = columns[name].astype(np.uint64)
        if name in ("fp", "sketch"):  # rows of one document follow each other
            out.append(column.tobytes())
        else:
            out += [(column >> np.uint64(16 * i)).astype(np.uint16).tobytes() for i in range(planes)]
    return b"".join(out)


def unpack(packed: bytes) -> dict[str, np.ndarray]:
    rows = len(packed) // (2 * sum(_PACKED.values()))
    out, at = {}, 0
    for name, planes in _PACKED.items():
        if name in ("fp", "sketch"):
            out[name] = np.frombuffer(packed, np.uint64, rows, at)
        else:
            out[name] = sum(np.frombuffer(packed, np.uint16, rows, at + 2 * rows * i).astype(np.uint64) << np.uint64(16 * i) for i in range(planes))
        at += 2 * rows * planes
    return out


def _signed(t: float, owners: tuple, answers: tuple, counts: bytes, asked: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(counts), np.uint8)
        got = parts.get(answers, TaskContext.get().partitionId(), _ANSWERS).sort_by([("block", "ascending"), ("bucket", "ascending")])
        numbers = np.asarray(got.column("block"))
        held: list[dict[str, np.ndarray]] = []

        def ranks(number: int, block: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
            known, code = _asked(block, table)
            order, bucket, packed = _questions(code, asked)
            a, b = np.searchsorted(numbers, [number, number + 1])
            rows = got.slice(a, b - a)
            if rows.column("bucket").to_pylist() != bucket.tolist() or rows.column("check").to_pylist() != [zlib.crc32(p) for p in packed]:
                raise parts.Moved
            answer = np.zeros(len(code), np.uint16)
            answer[order] = np.frombuffer(b"".join(map(zlib.decompress, rows.column("data").to_pylist())), np.uint8)
            rank = known.astype(np.uint16) + np.uint16(14)
            rank[known < KNOWN] = answer
            return rank

        def out() -> pa.RecordBatch:
            rows = {c: np.concatenate([h[c] for h in held]) for c in _PACKED}
            bucket = (rows["key"] >> np.uint64(48)).astype(np.int64)
            few = max(1, int(buckets**0.5))  # documents that share bigrams that very many have share many of them: they meet in few buckets
            bucket = np.where(table[slots(rows["key"])] >= HOT, bucket % few * (buckets // few), bucket % buckets)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = {c: v[order] for c, v in rows.items()}, bucket[order]
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [pack({c: v[i:j] for c, v in rows.items()}) for i, j in zip(start.tolist(), [*start[1:].tolist(), len(bucket)])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[start]), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

        for number, block in enumerate(_blocks(batches, owners)):
            rank, at = ranks(number, block), 0
            for grams, first, fp in block:
                keys, owner, place, sketch = signatures(grams, first, t, rank[at : at + len(grams)])
                at += len(grams)
                if len(keys):
                    held.append({"key": keys, "before": place[:, 1] & np.uint64(0xFFFFFFFF), "behind": place[:, 2], "fp": fp[owner].view(np.uint64), "sketch": sketch[:, 0], "n": np.diff(first)[owner].astype(np.uint64), "position": place[:, 0]})
                if sum(len(h["key"]) for h in held) >= HELD_KEYS:
                    yield out()
                    held = []
        if held:
            yield out()

    return run


def _near(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, need, count): of the pairs of rows with equal keys, those at an end of a run of shared bigrams of the prefixes.

    ``need`` is how many shared bigrams the prefixes of the pair must have;
    summed over all keys, ``count`` is how many they have.
    """
    n, place = rows["n"], rows["position"]
    ok = np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y]) - 1e-6
    x, y = x[ok], y[ok]
    shared = least_shared(n[x], n[y], t)
    need = np.minimum(needed(np.minimum(n[x], n[y])), shared)
    left_x, left_y = n[x] - shared + need - place[x], n[y] - shared + need - place[y]
    ok = (left_x > 0) & (left_y > 0)
    ok &= (np.maximum(n[x], n[y]) > SKETCHED) | (np.bitwise_count(rows["sketch"][x] ^ rows["sketch"][y]) <= n[x] + n[y] - 2 * shared)
    x, y, need, left_x, left_y = x[ok], y[ok], need[ok], left_x[ok], left_y[ok]
    starts = (place[x] == 0) | (place[y] == 0) | (rows["before"][x] != rows["before"][y])
    ends = (left_x == 1) | (left_y == 1) | (rows["behind"][x] != rows["behind"][y])
    count = np.where(ends, place[x] + 1, 0) - np.where(starts, place[x], 0)
    ok = count != 0
    return x[ok], y[ok], need[ok], count[ok]


def _bucket_pairs(rows: dict[str, np.ndarray], t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, need, count) of pairs of different sets with one key, a < b."""
    order = np.argsort(rows["key"])
    key = rows["key"][order]
    same = key[1:] == key[:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(order):
        return
    order = order[np.lexsort((rows["fp"][order].view(np.int64), rows["key"][order]))]
    rows = {c: v[order] for c, v in rows.items()}
    key, fp = rows["key"], rows["fp"].view(np.int64)
    keep = np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
    rows = {c: v[keep] if c in ("key", "before", "behind", "sketch") else v[keep].view(np.int64) for c, v in rows.items()}
    key, fp = rows["key"], rows["fp"]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([start, [len(key)]]))
    small = size <= 64

    def near(x: np.ndarray, y: np.ndarray):
        x, y, need, count = _near(rows, x, y, t)
        return fp[x], fp[y], need, count

    for k in range(2, 65):
        every = start[small & (size == k)]
        for s in range(0, len(every), max(1, PAIRS // (k * k))):
            at = every[s : s + max(1, PAIRS // (k * k))]
            i, j = np.triu_indices(k, 1)
            yield near((at[:, None] + i).ravel(), (at[:, None] + j).ravel())
    for s, c in zip(start[~small].tolist(), size[~small].tolist()):
        step = max(1, PAIRS // c)
        for i in range(0, c - 1, step):
            rows_ = np.arange(i, min(i + step, c))
            x, y = np.repeat(rows_, c - i), np.tile(np.arange(i, c), len(rows_))
            ok = x < y
            yield near(s + x[ok], s + y[ok])


def _join(t: float):
    """Rows (bucket, rows) sorted by bucket; counts of one pair are added up as far as they are at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            a, b, need, count = (np.concatenate([p[i] for p in parts]) for i in range(4))
            order = np.lexsort((b, a))
            a, b, need, count = a[order], b[order], need[order], count[order]
            start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            return a[start], b[start], need[start], np.add.reduceat(count, start) if len(a) else count

        def out(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            parts = [unpack(h) for h in held]
            found: list[tuple[np.ndarray, ...]] = []
            for pairs in _bucket_pairs({c: np.concatenate([p[c] for p in parts]) for c in _PACKED}, t):
                found.append(pairs)
                if sum(len(f[0]) for f in found) >= 2 * PAIRS:
                    yield from batches_of(add(found))
                    found = []
            if found:
                yield from batches_of(add(found))

        def batches_of(columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=["a", "b", "need", "count"])

        bucket, held = None, []
        for batch in batches:
            for number, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != bucket:
                    if held:
                        yield from out(held)
                    bucket, held = number, []
                held.append(rows)
        if held:
            yield from out(held)

    return run


def common_grams(grams: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j, all pairs of a block in one search."""
    size = np.diff(first)
    _, dense = np.unique(grams, return_inverse=True)
    span = int(dense.max(initial=0)) + 1
    placed = np.repeat(np.arange(len(size)), size) * span + dense  # ascending, as each set is
    small, large = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    ends = np.cumsum(size[small])
    out = np.zeros(len(i), np.int64)
    at = 0
    while at < len(i):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")))
        n = size[small[at:stop]]
        owner = np.repeat(np.arange(stop - at), n)
        sought = large[at:stop][owner] * span + dense[np.repeat(first[small[at:stop]] - np.cumsum(n) + n, n) + np.arange(len(owner))]
        found = placed[np.minimum(np.searchsorted(placed, sought), len(placed) - 1)] == sought
        out[at:stop] = np.bincount(owner[found], minlength=stop - at)
        at = stop
    return out


def _verify(t: float):
    """Rows (tile, a, b, text) sorted by tile: texts have no b, pairs no text; a tile may run over several batches."""

    def judge(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(tables).combine_chunks()
        is_text = np.asarray(rows.column("b").is_null())
        texts, pairs = rows.filter(pa.array(is_text)), rows.filter(pa.array(~is_text))
        if not len(pairs):
            return
        tile, fp = (np.asarray(texts.column(c)) for c in ("tile", "a"))
        grams, first, at = [], [], 0
        column = texts.column("text").combine_chunks()
        for a, b in K.slices(column):
            g, f = gram_sets(column.slice(a, b - a))
            grams.append(g)
            first.append(f[:-1] + at)
            at += len(g)
        grams, first = np.concatenate(grams), np.concatenate([*first, [at]])
        place = K.mix(tile.view(np.uint64), 29) ^ fp.view(np.uint64)
        order = np.argsort(place)
        pt, x, y = (np.asarray(pairs.column(c)) for c in ("tile", "a", "b"))
        i, j = (order[np.searchsorted(place[order], K.mix(pt.view(np.uint64), 29) ^ v.view(np.uint64))] for v in (x, y))
        size = np.diff(first)
        common = common_grams(grams, first, i, j)
        either = size[i] + size[j] - common
        ok = common >= t * either - 1e-9
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok]), pa.array(common[ok] / either[ok])], names=["a", "b", "jaccard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = np.asarray(batch.column("tile"))
            cut = int(np.searchsorted(tile, tile[-1], "left"))
            if cut or (held and held[0].column("tile")[0].as_py() != tile[0]):
                yield from judge([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from judge(held)

    return run


def signed(docs: DataFrame, nodes: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """Rows (bucket, rows): keys of the sets, packed. ``docs`` is the scan that ``nodes`` tells the partitions of."""
    texts = docs.select("text").filter("text is not null")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = parts.put(nodes.groupBy("fp").agg(F.min("part").alias("part")), "jaccard-owners")
    counts = sampled_counts(docs)
    asked = texts.mapInArrow(_ask(owners, counts, 8 * tasks), _ASKED)
    dealt = asked.repartitionById(tasks, F.expr(f"cast(bucket % {tasks} as int)")).sortWithinPartitions("bucket")
    answers = parts.put(dealt.mapInArrow(_answer, _ANSWER), "jaccard-answers")
    return texts.mapInArrow(_signed(t, owners, answers, counts, 8 * tasks, 2 * tasks), "bucket bigint, rows binary")


def set_pairs(docs: DataFrame, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, part) of the documents; rows (a, b, jaccard): fingerprints of the different sets with an index of at least ``t``, each pair once."""
    docs = parts.as_scan(docs.select("doc_id", "text").filter("doc_id is not null"), "jaccard-texts")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def make() -> tuple[DataFrame, DataFrame]:
        nodes = stash(_nodes(docs), "jaccard-nodes")
        met = signed(docs, nodes, t).repartitionById(tasks, F.expr(f"cast(bucket % {tasks} as int)")).sortWithinPartitions("bucket").mapInArrow(_join(t), "a bigint, b bigint, need bigint, count bigint")
        enough = met.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("count").alias("count")).filter("count >= need")
        return nodes, stash(enough.select("a", "b"), "jaccard-pairs")

    nodes, pairs = parts.settled(make)
    texts = docs.select("text").filter("text is not null")
    both = pairs.union(pairs.select("b", "a"))
    near = both.groupBy(F.col("a").alias("fp")).agg(F.least("fp", F.min("b")).alias("label"))
    near = stash(near, "jaccard-near")
    sizes = near.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    labels = stash(near.join(sizes, "label"), "jaccard-labels")
    side = lambda c: labels.select(F.col("fp").alias(c), F.col("label").alias(f"l{c}"), F.expr("pmod(xxhash64(fp), tiles)").alias(f"t{c}"))
    tiled = stash(pairs.join(side("a"), "a").join(side("b"), "b").select(F.xxhash64("la", "lb", "ta", "tb").alias("tile"), "a", "b"), "jaccard-tiles")
    wanted = tiled.select("tile", F.explode(F.array("a", "b")).alias("fp")).distinct()
    keys = labels.select("fp")
    if labels.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.slices(batch.column(0)):
                part = batch.column(0).slice(a, b - a)
                grams, first = gram_sets(part)
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(grams, first)), part], names=["fp", "text"])

    found = texts.mapInArrow(with_text, "fp bigint, text string").join(keys, "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text"))
    rows = wanted.join(found, "fp").select("tile", F.col("fp").alias("a"), F.lit(None).cast("bigint").alias("b"), "text").union(tiled.select("tile", "a", "b", F.lit(None).cast("string")))
    return nodes, rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_verify(t), "a bigint, b bigint, jaccard double")


def _nodes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null").mapInArrow(_sized, "doc_id bigint, fp bigint, part int").groupBy("doc_id", "fp").agg(F.min("part").alias("part"))


def similar_pairs(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """Rows (doc_a, doc_b, jaccard), doc_a < doc_b: documents whose bigram sets have a Jaccard index of at least ``t``.

    Documents with equal sets appear by the least doc_id of them; each other
    one is paired with that one, at 1. Tokens are parted by white space; a
    text of one token is one gram; null, empty and blank texts match nothing.
    Rows without doc_id are left out, rows that repeat count once, other
    columns are ignored, an empty table gives no rows.
    """
    nodes, pairs = set_pairs(docs, t)
    first = stash(nodes.groupBy("fp").agg(F.min("doc_id").alias("doc")), "jaccard-first")
    near = pairs.join(first.select(F.col("fp").alias("a"), F.col("doc").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("doc").alias("y")), "b")
    near = near.filter("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))
    copies = nodes.join(first, "fp").filter("doc_id > doc").select(F.col("doc").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.union(copies).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def document_classes(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, class_id, links): every document once, with its class and the number of documents it is linked to.

    A link is a Jaccard index of at least ``t`` (as in :func:`similar_pairs`);
    copies are linked to each other and to all that one of them is linked to,
    and are counted, not listed. A class is a connected component of links;
    its id is the least doc_id in it. A document without links is a class of
    its own; so is one whose texts are all null, empty or blank. A doc_id with
    several texts has the links of all of them, summed. Rows without doc_id are
    left out, rows that repeat count once, other columns are ignored, an empty
    table gives no rows.
    """
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    nodes, pairs = set_pairs(docs, t)
    sets = stash(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc")), "jaccard-sets")
    pairs = stash(pairs, "jaccard-links")
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    linked = both.join(sets.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    counted = nodes.join(sets.join(linked, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links")), "fp")
    # sets are nodes of the graph, by the least document of each; a doc_id with several sets joins them
    first = lambda c, x: sets.select(F.col("fp").alias(c), F.col("doc").alias(x))
    several = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id")
    edges = pairs.join(first("a", "x"), "a").join(first("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    edges = edges.union(nodes.join(several, "doc_id", "left_semi").join(first("fp", "x"), "fp").select("x", "doc_id"))
    roots = components(docs.sparkSession, edges).withColumnRenamed("node", "doc")
    known = sets.join(roots, "doc", "left").select("fp", F.coalesce("root", "doc").alias("class_id"))
    found = counted.join(known, "fp").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    alone = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(nodes, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return found.union(alone)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Rows (node, root): the least node of each connected component of the edges (a, b).

    Alternates large-star and small-star steps. The least neighbour of a node
    is aggregated before the shuffle and joined back, so a node with many edges
    is no task of its own; every round is written to the shared folder.
    """
    edges = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = stash(edges.join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct(), "edges")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        after = stash(small, "edges")
        if edges.count() == after.count() and not after.exceptAll(edges).limit(1).count():
            return after.select(F.col("b").alias("node"), F.col("a").alias("root")).union(after.select("a", "a").distinct())
        edges = after


def keep_one(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """The documents, but of each group linked by pairs only the one with the least doc_id; columns stay as they are.

    Rows that :func:`similar_pairs` leaves out (null, empty and blank texts, no
    doc_id) stay, and so do rows that repeat the doc_id of a kept document. An
    empty table stays empty.
    """
    pairs = similar_pairs(docs, t)
    name = fresh(docs, "gone")
    gone = components(docs.sparkSession, pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))).filter("node > root").select(F.col("node").alias(name))
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone[name], "left_anti")


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return document_classes(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: Sets as lists of hashes would need no text, but the lists themselves leave nothing to chance.
OP4_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM t WHERE len(w) > 0
), c AS (SELECT g, len(g) AS n, min(doc_id) AS doc, count(*) AS copies FROM s GROUP BY g
), e AS (SELECT doc, n, unnest(g) AS x FROM c
), p AS (
  SELECT a.doc AS a, b.doc AS b
  FROM e a JOIN e b ON a.x = b.x AND a.doc < b.doc AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) GROUP BY 1, 2
  HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.6 - 1e-9
), z AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), l AS (SELECT z.a AS doc, sum(c.copies) AS others FROM z JOIN c ON z.b = c.doc GROUP BY 1
), r AS (SELECT a, b FROM z UNION SELECT r.a, z.b FROM r JOIN z ON r.b = z.a
), k AS (SELECT a AS doc, least(a, min(b)) AS class_id FROM r GROUP BY a)
SELECT s.doc_id, coalesce(k.class_id, c.doc) AS class_id, (c.copies - 1 + coalesce(l.others, 0))::BIGINT AS links
FROM s JOIN c USING (g) LEFT JOIN l ON l.doc = c.doc LEFT JOIN k ON k.doc = c.doc
UNION ALL SELECT DISTINCT doc_id, doc_id, 0::BIGINT FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM s)
"""
