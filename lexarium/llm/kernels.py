"""Vectorised text kernels shared by the training-data operators.

Everything here works on one Arrow string array at a time inside an Arrow
``mapInArrow`` worker: no Python-level loop runs over characters or words.
Tokens are maximal runs of bytes other than space, tab, newline, form feed and
carriage return (the class ``\\s`` of RE2, so SQL oracles can restate it).
Hashes are 64-bit polynomial prefix hashes followed by a finaliser; equal
strings always have equal hashes and different ones collide with probability
about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 256 << 10
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POW: list[np.ndarray] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser; ``seed`` selects one of many independent functions."""
    x = x.astype(np.uint64, copy=True)
    x ^= np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK_BYTES // 4)
        inverse = pow(_BASE, -1, 2**64)
        for base, at in ((_BASE, 0), (inverse, 1)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                powers = np.multiply.accumulate(steps)
            _POW[at : at + 1] = [powers]
    return _POW[0], _POW[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of values[j] * base**j for j < i, modulo 2**64."""
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every span [start, end) given :func:`prefix_sums`."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def slices(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose bytes stay near ``max_bytes``; one longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    start, total = 0, 0
    ends = np.cumsum(sizes)
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, total + max_bytes, "right")))
        yield start, end
        total, start = int(ends[end - 1]), end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty texts; offsets start at 0."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def token_spans(raw: np.ndarray, offsets: np.ndarray, token_byte: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the tokens; text d owns tokens first[d] to first[d+1].

    ``token_byte`` tells which bytes belong to tokens; by default all but white space.
    """
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = (~_SPACE if token_byte is None else token_byte)[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the tokens of a string array."""
    raw, offsets = text_bytes(column)
    starts, ends, first = token_spans(raw, offsets)
    return span_hash(prefix_sums(BYTE_CODE[raw]), starts, ends), first


def hash_word(word: str) -> int:
    """The hash that :func:`token_hashes` gives one token."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_sums(BYTE_CODE[raw]), np.array([0]), np.array([len(raw)]))[0])


def owners(first: np.ndarray) -> np.ndarray:
    """Index of the text that owns each token."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ngram_hashes(tokens: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owner, position) of every run of ``n`` tokens inside one text."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    base = np.cumsum(count) - count
    position = np.arange(len(owner)) - base[owner]
    start = first[:-1][owner] + position
    return span_hash(prefix_sums(tokens), start, start + n), owner, position
