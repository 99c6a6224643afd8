from __future__ import annotations

import gzip
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexarium.errors import DecompressionFailed, InvalidFormat
from lexarium.functions import codec, encoding, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tokenize(spark):
    assert one(spark, text.tokenize("t"), t="The cat2dog, é été 12345 x") == ["the", "cat", "dog", "été", "12345"]
    assert one(spark, text.tokenize("t", ["the"]), t="The " + "a" * 65) == []
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) is None


def test_snippet_and_tags(spark):
    assert one(spark, text.snippet("t", ["fox", "dog"], 10), t="The quick brown fox and the dog") == "rown fox and th"
    assert one(spark, text.snippet("t", ["cat"], 10), t="none") is None
    assert one(spark, text.strip_tags("t"), t=" <p>a <b>b</b></p> ") == "a b"
    assert one(spark, text.sanitize("t"), t="a\x00b\n\tc\x7f") == "ab\n\tc"
    assert len(one(spark, text.sanitize("t"), t="é" * 5000).encode()) == 4096
    assert one(spark, text.entry_links("t"), t="@@@LINK=other\r\n") == "other"


@given(st.binary(max_size=2000), st.sampled_from(["none", "gzip", "lz4", "zstd"]))
def test_round_trip(data, algorithm):
    assert codec.decompress_bytes(codec.compress_bytes(data, algorithm), algorithm) == data


@pytest.mark.parametrize("bad", [b"\x1f\x00", b"\x00\x8b", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00" + b"\xff" * 4, gzip.compress(b"x" * 999)[:-9]])
def test_bad_gzip(bad):
    with pytest.raises(DecompressionFailed):
        codec.decompress_bytes(bad)


def test_limits_and_levels():
    with pytest.raises(DecompressionFailed):
        codec.decompress_bytes(codec.compress_bytes(b"0" * 1000), limit=999)
    assert [codec.clamp_level(*x) for x in ((15, "gzip"), (25, "zstd"), (5, "none"))] == [9, 19, 5]
    assert codec.decompress_bytes(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"


def test_hashes(spark):
    row = spark.createDataFrame([(b"abc",)], "d binary").select(codec.adler32("d").alias("a"), codec.fast_hash("d").alias("f"), F.hex(codec.secure_hash("d")).alias("s"), codec.crc32("d").alias("c"), codec.verify_crc32("d", zlib.crc32(b"abc")).alias("v")).first()
    assert row["a"] == zlib.adler32(b"abc") and row["c"] == zlib.crc32(b"abc") and row["v"]
    assert row["f"] & (2**64 - 1) == 0x44BC2CF5AD770999
    assert row["s"].startswith("BA7816BF8F01CFEA")


@given(st.integers(0, 2**64 - 1), st.text(max_size=50))
def test_numbers(n, s):
    reader = codec.Reader(codec.write_varint(n) + codec.write_string(s) + codec.write_number(n, 8, "big"))
    assert (reader.varint(), reader.string(), reader.number(8, "big")) == (n, s, n)
    with pytest.raises(InvalidFormat):
        reader.number(1)


def test_number_at(spark):
    df = spark.createDataFrame([(b"\x01\x02\x03\x04",)], "d binary")
    assert tuple(df.select(codec.number_at("d", 1, 2), codec.number_at("d", 0, 4, "little")).first()) == (0x0203, 0x04030201)
    with pytest.raises(InvalidFormat):
        codec.Reader(b"\xff" * 11).varint()


def test_encodings(spark):
    gbk = bytes.fromhex("D6D0B9FAC8CBC2DBCAC7")
    assert encoding.detect(gbk) == "GB2312" and encoding.convert(gbk, "GB2312").startswith("中国")
    assert [encoding.detect(x) for x in ("Hello 🌟".encode(), b"abc", b"", b"\xff\xfea\0", b"\xfe\xff\0a")] == ["UTF-8", "UTF-8", "Unknown", "UTF-16LE", "UTF-16BE"]
    assert encoding.detect("café olé".encode("latin-1")) == "Windows-1252"
    assert encoding.convert(b"\x80\x81", "Windows-1252") == "€\x81"
    with pytest.raises(InvalidFormat):
        encoding.convert(b"\xff", "UTF-8")
    df = spark.createDataFrame([(1, gbk), (2, "é".encode()), (3, b""), (4, None), (5, b"\xff\xfea\0")], "i int, d binary")
    got = {r[0]: r[1:] for r in df.select("i", encoding.detect_encoding("d"), encoding.to_utf8("d")).collect()}
    assert got == {1: ("GB2312", encoding.convert(gbk, "GB2312")), 2: ("UTF-8", "é"), 3: ("Unknown", ""), 4: (None, None), 5: ("UTF-16LE", "﻿a")}
