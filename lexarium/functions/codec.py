"""Checksums, hashes, compression and binary numbers as column functions.

What the JVM has is used from there; the rest are Arrow functions over whole
batches.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
import struct
import zlib
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexarium.errors import DecompressionFailed, InvalidFormat, Unsupported

from . import lzo

LIMIT = 128 << 20
CHUNK = 8 << 10
LEVELS = {"none": (0, 1, 1), "gzip": (9, 9, 6), "lz4": (0, 1, 1), "zstd": (19, 19, 6)}  # clamp (0: as given), most, suggested


def compress_bytes(data: bytes, algorithm: str = "gzip", level: int | None = None) -> bytes:
    level = suggested_level(algorithm) if level is None else clamp_level(level, algorithm)
    if algorithm == "none":
        return data
    if algorithm == "gzip":
        return gzip.compress(data, level, mtime=0)
    if algorithm in ("lz4", "zstd"):
        with pa.BufferOutputStream() as sink:
            with pa.CompressedOutputStream(sink, algorithm) as out:
                out.write(data)
            return sink.getvalue().to_pybytes()
    raise Unsupported(algorithm)


def decompress_bytes(data: bytes, algorithm: str = "gzip", limit: int = LIMIT) -> bytes:
    """Raises where the stream is broken, cut or grows beyond ``limit``; nothing is returned in part."""
    try:
        if algorithm == "none":
            out = data
        elif algorithm in ("gzip", "zlib", "deflate"):
            bits = {"gzip": 31, "zlib": 15, "deflate": -15}[algorithm]
            parts, rest, size = [], data, 0
            while rest:
                stream = zlib.decompressobj(bits)
                parts.append(stream.decompress(rest, limit + 1 - size))
                size += len(parts[-1])
                if size > limit:
                    raise DecompressionFailed(f"more than {limit} bytes")
                if not stream.eof:
                    raise DecompressionFailed("the stream ends early")
                rest = stream.unused_data if algorithm == "gzip" else b""
            out = b"".join(parts)
        elif algorithm in ("lz4", "zstd"):
            with pa.CompressedInputStream(pa.BufferReader(data), algorithm) as stream:
                out = stream.read(limit + 1)
        elif algorithm == "lzo":
            out = lzo.decompress(data, limit)
        elif algorithm == "bz2":
            stream = bz2.BZ2Decompressor()
            out = stream.decompress(data, limit + 1)
            if len(out) <= limit and not stream.eof:
                raise DecompressionFailed("the stream ends early")
        elif algorithm == "xz":
            out = lzma.LZMADecompressor().decompress(data, limit + 1)
        else:
            raise Unsupported(algorithm)
    except (zlib.error, OSError, lzma.LZMAError, EOFError) as e:
        raise DecompressionFailed(str(e)) from e
    if len(out) > limit:
        raise DecompressionFailed(f"more than {limit} bytes")
    return out


def compress_stream(source: BinaryIO, target: BinaryIO, algorithm: str = "gzip", chunk: int = CHUNK) -> int:
    """Compress all of ``source`` into ``target``, a chunk at a time; the number of bytes read."""
    if algorithm not in LEVELS:
        raise Unsupported(algorithm)
    if algorithm == "none":
        return _pump(source, target, chunk)
    with pa.CompressedOutputStream(pa.PythonFile(_Open(target), mode="w"), algorithm) as stream:
        return _pump(source, stream, chunk)


def decompress_stream(source: BinaryIO, target: BinaryIO, algorithm: str = "gzip", chunk: int = CHUNK) -> int:
    """Restore what :func:`compress_stream` wrote; the number of bytes written."""
    if algorithm not in LEVELS:
        raise Unsupported(algorithm)
    if algorithm == "none":
        return _pump(source, target, chunk)
    try:
        with pa.CompressedInputStream(pa.PythonFile(source, mode="r"), algorithm) as stream:
            return _pump(stream, target, chunk)
    except OSError as e:
        raise DecompressionFailed(str(e)) from e


def _pump(source, target, chunk: int) -> int:
    total = 0
    while data := source.read(chunk):
        target.write(data)
        total += len(data)
    return total


class _Open:
    """A file that the stream around it does not close."""

    closed = False

    def __init__(self, file):
        self.file = file

    def write(self, data) -> int:
        return self.file.write(bytes(data))

    def flush(self) -> None:
        pass

    def close(self) -> None:
        pass


def compress(data: Column | str, algorithm: str = "gzip", level: int | None = None) -> Column:
    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else compress_bytes(x, algorithm, level) for x in column.to_pylist()], pa.binary())

    return run(data)


def decompress(data: Column | str, algorithm: str = "gzip", limit: int = LIMIT) -> Column:
    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decompress_bytes(x, algorithm, limit) for x in column.to_pylist()], pa.binary())

    return run(data)


def clamp_level(level: int, algorithm: str) -> int:
    top = LEVELS[algorithm][0]
    return min(level, top) if top else level


def max_level(algorithm: str) -> int:
    return LEVELS[algorithm][1]


def suggested_level(algorithm: str) -> int:
    return LEVELS[algorithm][2]


def estimated_ratio(algorithm: str, level: Column) -> Column:
    """Expected size before over size after."""
    if algorithm == "none":
        return F.lit(1.0)
    if algorithm == "gzip":
        return F.least(F.least(level, F.lit(9)) / 9.0 * 2.0 + 1.0, F.lit(4.0))
    if algorithm == "lz4":
        return 2.0 + level / 10.0
    if algorithm == "zstd":
        return F.least(F.least(level, F.lit(19)) / 19.0 * 4.0 + 1.5, F.lit(6.0))
    raise Unsupported(algorithm)


SETTINGS = {
    "none": (False, False, 1.0, "very fast", 0),
    "gzip": (True, False, 2.5, "fast", 256 << 10),
    "lz4": (True, True, 2.0, "very fast", 64 << 10),
    "zstd": (True, True, 3.5, "medium", 512 << 10),
}


def settings(spark):
    """Rows (algorithm, streaming, dictionary, ratio, speed, memory_bytes)."""
    return spark.createDataFrame([(k, *v) for k, v in SETTINGS.items()], "algorithm string, streaming boolean, dictionary boolean, ratio double, speed string, memory_bytes bigint")


def crc32(data: Column | str) -> Column:
    return F.crc32(data)


def verify_crc32(data: Column | str, expected: Column | int) -> Column:
    return F.crc32(data) == (expected if isinstance(expected, Column) else F.lit(expected))


@F.arrow_udf(LongType())
def adler32(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else zlib.adler32(x) for x in column.to_pylist()], pa.int64())


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & (2**64 - 1)


_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def xxh64(data: bytes, seed: int = 0) -> int:
    """The 64-bit XXH hash, unsigned."""
    m = 2**64 - 1
    try:
        import xxhash

        return xxhash.xxh64_intdigest(data, seed)
    except ImportError:
        pass
    n, at = len(data), 0
    step = lambda acc, lane: (_rotl((acc + lane * _P2) & m, 31) * _P1) & m
    if n >= 32:
        v = [(seed + _P1 + _P2) & m, (seed + _P2) & m, seed & m, (seed - _P1) & m]
        while at + 32 <= n:
            v = [step(x, y) for x, y in zip(v, struct.unpack_from("<4Q", data, at))]
            at += 32
        h = (_rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)) & m
        for x in v:
            h = ((h ^ step(0, x)) * _P1 + _P4) & m
    else:
        h = (seed + _P5) & m
    h = (h + n) & m
    while at + 8 <= n:
        h = (_rotl(h ^ step(0, struct.unpack_from("<Q", data, at)[0]), 27) * _P1 + _P4) & m
        at += 8
    if at + 4 <= n:
        h = (_rotl(h ^ (struct.unpack_from("<I", data, at)[0] * _P1 & m), 23) * _P2 + _P3) & m
        at += 4
    for byte in data[at:]:
        h = (_rotl(h ^ (byte * _P5 & m), 11) * _P1) & m
    h = ((h ^ (h >> 33)) * _P2) & m
    h = ((h ^ (h >> 29)) * _P3) & m
    return h ^ (h >> 32)


@F.arrow_udf(LongType())
def fast_hash(column: pa.Array) -> pa.Array:
    """The 64-bit XXH hash with seed 0, as a signed number."""
    out = [None if x is None else xxh64(x) for x in column.to_pylist()]
    return pa.array([None if h is None else h - 2**64 if h >= 2**63 else h for h in out], pa.int64())


def secure_hash(data: Column | str) -> Column:
    """SHA-256 as bytes."""
    return F.unhex(F.sha2(data, 256))


def hash_files(spark, path: str):
    """Rows (path, size, crc32, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.crc32("content").alias("crc32"), F.sha2("content", 256).alias("sha256"))


def file_sha256(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").digest()


class Reader:
    """Numbers and strings from bytes; runs past the end raise."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise InvalidFormat(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int, order: str = "little") -> int:
        return int.from_bytes(self.take(size), order)

    def varint(self) -> int:
        out = shift = 0
        while True:
            byte = self.number(1)
            if shift > 63:
                raise InvalidFormat("a number of more than 64 bits")
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    def string(self) -> str:
        raw = self.take(self.varint())
        try:
            return raw.decode()
        except UnicodeDecodeError as e:
            raise InvalidFormat("a string that is not UTF-8") from e

    def until(self, mark: bytes = b"\0") -> bytes:
        i = self.data.find(mark, self.at)
        if i < 0:
            raise InvalidFormat("no end of a string")
        out, self.at = self.data[self.at : i], i + len(mark)
        return out


def write_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def write_number(n: int, size: int, order: str = "little") -> bytes:
    return n.to_bytes(size, order)


def write_string(text: str) -> bytes:
    raw = text.encode()
    return write_varint(len(raw)) + raw


def number_at(data: Column | str, offset: int, size: int, order: str = "big") -> Column:
    """Up to seven bytes of a binary column as a number, inside the JVM."""
    hexed = F.hex(F.substring(F.col(data) if isinstance(data, str) else data, offset + 1, size))
    if order == "little":
        hexed = F.array_join(F.reverse(F.regexp_extract_all(hexed, F.lit("(..)"), 1)), "")
    return F.conv(hexed, 16, 10).cast("bigint")
