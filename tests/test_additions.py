"""Streams, LZO, timers, checksums against other implementations, and a saved lexicon as a whole."""

from __future__ import annotations

import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexarium.errors import DecompressionFailed, IndexMissing, Unsupported
from lexarium.functions import codec, lzo, timing
from lexarium.lexicon import Lexicon
from lexarium.operators import lookup, search
from lexarium.sources import files, lexicon_source, sinks
from lexarium.sources.formats import MDict


@pytest.mark.parametrize("algorithm", ["none", "gzip", "lz4", "zstd"])
@pytest.mark.parametrize("size", [0, 1, 8192, 100_001])
def test_streams(algorithm, size):
    data = random.Random(size).randbytes(size // 2) + b"a" * (size - size // 2)
    packed, out = io.BytesIO(), io.BytesIO()
    assert codec.compress_stream(io.BytesIO(data), packed, algorithm) == size
    assert codec.decompress_stream(io.BytesIO(packed.getvalue()), out, algorithm) == size and out.getvalue() == data
    if size:
        assert codec.decompress_bytes(packed.getvalue(), algorithm) == data


def test_broken_streams():
    with pytest.raises(DecompressionFailed):
        codec.decompress_stream(io.BytesIO(b"not gzip"), io.BytesIO(), "gzip")
    with pytest.raises(Unsupported):
        codec.compress_stream(io.BytesIO(b""), io.BytesIO(), "brotli")


END = b"\x11\0\0"
LZO = [
    (b"\x15abcd" + END, b"abcd"),
    (b"\x15abcd" + bytes([(3 << 5) | (3 << 2), 0]) + END, b"abcdabcd"),  # a short match
    (b"\x15abcd" + bytes([(3 << 5) | (3 << 2) | 2, 0]) + b"xy" + END, b"abcdabcdxy"),  # and two literals after it
    (b"\x15abcd" + bytes([(3 << 5) | (3 << 2) | 1, 0]) + b"x" + bytes([1 << 2, 0]) + END, b"abcdabcdx" + b"dx"),  # two bytes after literals
    (b"\x15abcd" + bytes([32 | 8, 3 << 2, 0]) + END, b"abcd" + b"abcdabcdab"),  # a medium one that overlaps itself
    (b"\x15abcd" + bytes([32, 9, 3 << 2, 0]) + END, b"abcd" * 11 + b"ab"[:2]),  # its length in a byte of its own
    (b"\0" + bytes([2]) + b"q" * 20 + END, b"q" * 20),  # a long run of literals
    (b"\x12a" + bytes([0, 0]) + END, b"aaa"),
]


@pytest.mark.parametrize(("packed", "plain"), LZO)
def test_lzo(packed, plain):
    assert lzo.decompress(packed, 1000) == plain
    dictionary = MDict.__new__(MDict)
    assert dictionary._block(b"\1\0\0\0" + zlib.adler32(plain).to_bytes(4, "big") + packed, len(plain)) == plain


@pytest.mark.parametrize("packed", [b"", b"\x15abc", b"\x15abcd", b"\x15abcd" + bytes([(3 << 5) | (7 << 2), 0]) + END, b"\x15abcd" + END + b"x"])
def test_lzo_broken(packed):
    with pytest.raises(DecompressionFailed):
        lzo.decompress(packed, 1000)
    with pytest.raises(DecompressionFailed):
        lzo.decompress(b"\x15abcd" + bytes([32, 0, 0, 0, 9, 3 << 2, 0]) + END, 100)


def test_timing(spark):
    p = timing.Profiler()
    found, seconds = timing.measure(lambda: 7)
    p.record("x", seconds + 0.5)
    p.record("x", 0.5)
    assert found == 7 and p.calls == {"x": 2} and 1 < p.operations_per_second("x") <= 2 and p.elapsed() > 0
    assert p.operations_per_second("y") == 0 and [r["calls"] for r in p.table(spark).collect()] == [2]
    ran = []
    times = timing.benchmark(lambda: ran.append(1), 12)
    assert len(ran) == 22 and times["min"] <= times["mean"] <= times["max"]
    with pytest.raises(ValueError):
        timing.benchmark(ran.clear, 0)


def test_checksums_against_others(spark):
    xxhash = pytest.importorskip("xxhash")
    data = [b"", b"a", bytes(range(256)) * 5, "ünïcödé 🌟".encode(), *(random.Random(i).randbytes(i) for i in range(40))]
    df = spark.createDataFrame([(x,) for x in data], "x binary").select("x", codec.crc32("x").alias("crc"), codec.adler32("x").alias("adler"), codec.fast_hash("x").alias("hash"))
    for r in df.collect():
        x = bytes(r["x"])
        assert r["crc"] == zlib.crc32(x) and r["adler"] == zlib.adler32(x)
        assert r["hash"] % 2**64 == xxhash.xxh64(x).intdigest()


def lexicon(spark, rows):
    return spark.createDataFrame([(d, i, k, t.encode(), t) for i, (d, k, t) in enumerate(rows)], "dict_id string, ord bigint, key string, entry binary, text string")


def test_merge_written_in_one_go(spark, tmp_path):
    a, b = (lexicon(spark, [("d", k, t) for k, t in rows]) for rows in ([("sun", "bright star"), ("moon", "pale disc")], [("moon", "bright disc"), ("tide", "water")]))
    path = f"file://{tmp_path}/merged"
    merged = Lexicon.merge([Lexicon(a), Lexicon(b)], "both", path)
    assert merged.built and {r["key"] for r in merged.fulltext("bright").collect()} == {"sun", "moon"}
    again = Lexicon.load(spark, path).reload()
    assert again.built and [r["n"] for r in again.verify().collect()] == [0] * 4
    assert not again.clear_index().built and again.clear_index().verify().isEmpty()
    with pytest.raises(IndexMissing):
        Lexicon(a).reload()
    again.entries.union(lexicon(spark, [("both", "zz", "")])).write.parquet(f"file://{tmp_path}/broken")
    assert Lexicon(spark.read.parquet(f"file://{tmp_path}/broken")).verify().collect()[0]["problem"] == "empty entry"


def test_saved_index_finds_every_posting(spark, tmp_path):
    colours = "red green blue black white brown grey".split()
    rows = [(f"d{i % 3}", f"k{i}", f"common {colours[i % 7]}") for i in range(200)]
    saved = Lexicon(lexicon(spark, rows)).save(f"file://{tmp_path}/saved")
    assert search.fulltext(saved.index, "common").count() == 200 and search.fulltext(saved.index, "green grey").count() == 57
    assert search.fulltext(saved.index, "absent").isEmpty() and search.fulltext(saved.index, "").isEmpty()


def test_order_over_ranges(spark):
    lex = lexicon(spark, [("d", f"k{i:04d}", "t") for i in range(500)])
    assert lookup.out_of_order(lex).isEmpty()
    broken = lex.withColumn("key", F.expr("if(ord % 50 = 0, 'a', key)"))
    got = sorted(tuple(r) for r in lookup.out_of_order(broken).collect())
    assert got == [("d", i, "a", f"k{i - 1:04d}") for i in range(50, 500, 50)]


def test_text_filters_look_at_last_entries(spark):
    lex = lexicon(spark, [("d", "k", "Old Thing"), ("d", "k", "new"), ("e", "k", "thing"), ("d", "thing", "x")])
    assert [(r["dict_id"], r["key"]) for r in lookup.substring(lex, "THING").collect()] == [("e", "k")]
    assert sorted((r["dict_id"], r["key"]) for r in lookup.key_or_text(lex, "thing").collect()) == [("d", "thing"), ("e", "k")]


def test_stardict_laid_out_by_hand(spark, tmp_path):
    """Bytes from the description of the format, not from the writer here."""
    body = b"first entry" + "zweiter Eintrag".encode() + b"third"
    places = [(b"alpha", 0, 11), (b"beta", 11, 15), (b"gamma", 26, 5)]
    index = b"".join(k + b"\0" + o.to_bytes(4, "big") + n.to_bytes(4, "big") for k, o, n in places)
    base = f"{tmp_path}/hand"
    files.write(f"{base}.ifo", b"StarDict's dict ifo file\nversion=2.4.2\nbookname=By hand\nwordcount=3\nidxfilesize=%d\nsynwordcount=1\n" % len(index))
    files.write(f"{base}.idx", index)
    files.write(f"{base}.dict", body)
    files.write(f"{base}.syn", b"second\0" + (1).to_bytes(4, "big"))
    for options in ({}, {"partitions": 3}):
        got = {r["key"]: r["text"] for r in lexicon_source.load(spark, f"{base}.ifo", **options).collect()}
        assert got == {"alpha": "first entry", "beta": "zweiter Eintrag", "gamma": "third", "second": "zweiter Eintrag"}
    assert lexicon_source.metadata(spark, f"{base}.ifo").first()["name"] == "By hand"


@pytest.mark.parametrize("format_", ["stardict", "bgl", "zim", "mdict", "dsl"])
def test_any_number_of_tasks_reads_the_same(spark, tmp_path, format_):
    lex = lexicon(spark, [("d", f"k{i:03d}", f"text {i} " + "x" * (i % 50)) for i in range(300)])
    found = sinks.write_containers(lex, f"file://{tmp_path}", format_)
    one = sorted(tuple(r) for r in lexicon_source.load(spark, *found).select("ord", "key", "text").collect())
    many = lexicon_source.load(spark, *found, partitions=7)
    assert len(one) == 300 and sorted(tuple(r) for r in many.select("ord", "key", "text").collect()) == one
    assert format_ == "mdict" or many.rdd.getNumPartitions() == 7


def test_containers_have_a_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MAX_CONTAINER", 10)
    with pytest.raises(Unsupported):
        sinks.write_containers(lexicon(spark, [("d", "key", "a long entry")]), f"file://{tmp_path}", "dsl")


def test_bgl_laid_out_by_hand(spark, tmp_path):
    words = b"one\0\0first\0" + b"two\0\0second\0"
    path = f"{tmp_path}/hand.bglx"
    files.write(path, b"BGLX" + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + (24).to_bytes(8, "little") + words)
    for options in ({}, {"partitions": 2}):
        assert {r["key"]: r["text"] for r in lexicon_source.load(spark, path, **options).collect()} == {"one": "first", "two": "second"}
