from __future__ import annotations

import struct

import pytest

from lexarium import cli
from lexarium.errors import ChecksumMismatch, InvalidFormat, LexiconError, NotFound, Unsupported
from lexarium.sources import files, formats, lexicon_source, sinks
from lexarium.sources.ripemd import ripemd128

ENTRIES = [("alpha", b"first entry"), ("beta", "zweiter é".encode()), ("gamma", b"third"), ("你好", b"hello")]


def put(folder, name, written):
    for tail, data in written.items():
        files.write(f"{folder}/{name}.{tail}", data)


def read(path, **kw):
    d = formats.open_dictionary(str(path), **kw)
    return {k: v for _, k, v in d.entries(0, d.rows())}


@pytest.mark.parametrize("packed", [False, True])
def test_stardict(tmp_path, packed):
    put(tmp_path, "d", sinks.stardict("Book", ENTRIES, [("a1", 0), ("beta", 0), ("g2", 2)], packed))
    want = dict(ENTRIES) | {"a1": b"first entry", "g2": b"third"}
    assert read(tmp_path / "d.ifo") == want
    assert formats.open_dictionary(str(tmp_path / "d.ifo")).metadata()["name"] == "Book"
    if not packed:
        assert read(tmp_path / "d.dict") == want
    (tmp_path / "d.ifo").write_text("StarDict's dict ifo file\nversion=3.0.0\nidxoffsetbits=64\n")
    with pytest.raises(Unsupported):
        read(tmp_path / "d.ifo")


def test_zim(tmp_path):
    put(tmp_path, "z", sinks.zim("z", ENTRIES, [("r1", 0), ("r2", 4), ("loop", 6)], per_cluster=3))
    assert read(tmp_path / "z.zim") == dict(ENTRIES) | {"r1": b"first entry", "r2": b"first entry"}
    put(tmp_path, "raw", sinks.zim("z", ENTRIES, codec=1))
    assert read(tmp_path / "raw.zim") == dict(ENTRIES)
    assert formats.open_dictionary(str(tmp_path / "z.zim")).mime_types() == ["text/plain"]


@pytest.mark.parametrize("encrypted", [False, True])
@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16"])
def test_mdict(tmp_path, encrypted, encoding):
    put(tmp_path, "m", sinks.mdict("A long title", ENTRIES, 3, encrypted, encoding))
    assert read(tmp_path / "m.mdx") == dict(ENTRIES)
    assert formats.open_dictionary(str(tmp_path / "m.mdx")).metadata()["name"] == "A long title"
    assert formats.sniff((tmp_path / "m.mdx").read_bytes()[:4096]) == "mdict"
    data = bytearray((tmp_path / "m.mdx").read_bytes())
    data[-1] ^= 1
    (tmp_path / "bad.mdx").write_bytes(data)
    with pytest.raises(LexiconError):
        read(tmp_path / "bad.mdx")
    data[20] ^= 1
    (tmp_path / "bad.mdx").write_bytes(data)
    with pytest.raises(ChecksumMismatch):
        read(tmp_path / "bad.mdx")


def test_dsl(tmp_path):
    text = '#NAME "N"\n#CONTENTS_LANGUAGE "French"\n\nhead {{c}}one\nhead two\n\t[m1]body [t]x[/t][/m]\n\tplain\n\nlone\nlast\n\t\\[not a tag\\] [s]a.wav[/s]\n'
    (tmp_path / "d.dsl").write_bytes(text.encode("utf-16"))
    strict = read(tmp_path / "d.dsl")
    assert set(strict) == {"head one", "head two", "lone", "last"} and strict["head two"] == b"[m1]body [t]x[/t][/m]\nplain"
    assert formats.open_dictionary(str(tmp_path / "d.dsl")).metadata()["language"] == "French"
    loose = read(tmp_path / "d.dsl", strict=False)
    assert "head one" not in loose and "lone" not in loose and loose["head two"] == b"[m1]body [t]x[/t][/m]"
    tags = formats.dsl_tags(strict["last"].decode())
    assert tags["has_media"] and not tags["has_transcription"] and tags["plain"] == "[not a tag] a.wav"
    assert formats.dsl_tags("[m1]a[/m] b")["margin_tags"] == ["m1"]


def test_bgl(tmp_path):
    put(tmp_path, "b", sinks.bgl("b", ENTRIES))
    assert read(tmp_path / "b.bglx") == dict(ENTRIES) and read(tmp_path / "b.bglx") == read(tmp_path / "b.bglx")


@pytest.mark.parametrize("head", [b"MDict", b"MDictVersion", b"", b"\xff" * 4, b"\0" * 4, bytes.fromhex("DEADBEEFCAFEBABE"), struct.pack(">I", 32) + "<Dict".encode("utf-16-le") + b"\0" * 16])
@pytest.mark.parametrize("kind", formats.FORMATS)
def test_broken_files(tmp_path, head, kind):
    path = tmp_path / f"x.{sinks.MAIN[kind]}"
    path.write_bytes(head)
    if kind == "dsl":
        read(path)  # any text is a DSL file
    else:
        with pytest.raises(LexiconError):
            read(path)


def test_detection(tmp_path):
    names = {"a.mdx": "mdict", "a.mdict": "mdict", "a.dict": "stardict", "a.zim": "zim", "a.dsl": "dsl"}
    assert {n: formats.detect_format(n) for n in names} == names
    (tmp_path / "x").write_bytes(struct.pack(">I", 32) + "<Dict".encode("utf-16-le") + b"\0" * 16)
    assert formats.detect_format(str(tmp_path / "x")) == "mdict"
    (tmp_path / "e").write_bytes(b"")
    (tmp_path / "u").write_bytes(b"plain words")
    for name, error in (("e", InvalidFormat), ("u", Unsupported), ("none", NotFound)):
        with pytest.raises(error):
            formats.detect_format(str(tmp_path / name))


def test_table(spark, tmp_path):
    put(tmp_path, "s", sinks.stardict("S", ENTRIES))
    put(tmp_path, "z", sinks.zim("z", ENTRIES))
    (tmp_path / "other.txt").write_text("no dictionary")
    assert lexicon_source.scan(spark, str(tmp_path)).count() == 2
    df = lexicon_source.load(spark, str(tmp_path), partitions=2)
    assert df.count() == 8 and df.filter("key = 'beta'").count() == 2 and df.filter("dict_id = 's.ifo'").count() == 4
    assert lexicon_source.load(spark, str(tmp_path), key="beta", dictId="z.zim").count() == 1 and lexicon_source.load(spark, str(tmp_path), keyPrefix="g").count() == 2 and df.count() == 8
    assert {r["key"]: r["text"] for r in df.filter("dict_id = 'z.zim'").collect()} == {k: v.decode() for k, v in ENTRIES}
    got = {r["path"].rsplit("/", 1)[-1]: r["valid"] for r in lexicon_source.validate(spark, str(tmp_path / "s.ifo"), str(tmp_path / "other.txt")).collect()}
    assert got == {"s.ifo": True, "other.txt": False}
    assert {r["name"] for r in lexicon_source.metadata(spark, str(tmp_path / "s.ifo"), str(tmp_path / "z.zim")).collect()} == {"S", "z"}
    assert cli.main(["search", "al", str(tmp_path / "s.ifo")], spark) == [("s.ifo", "alpha", None)]
    assert cli.main(["validate", str(tmp_path / "s.ifo")], spark)[0][2] is True
    assert cli.main(["info", str(tmp_path / "s.ifo")], spark)[0][1] == "S"
    assert len(sinks.copy_dictionary(str(tmp_path / "s.ifo"), str(tmp_path / "t.ifo"))) == 3 and read(tmp_path / "t.ifo") == dict(ENTRIES)
    assert len(sinks.remove_dictionary(str(tmp_path / "t.ifo"))) == 3


def test_fields_and_hash():
    assert lexicon_source.stardict_fields(b"tr\0body", "tm") == [("t", b"tr"), ("m", b"body")]
    assert lexicon_source.stardict_fields(struct.pack(">I", 3) + b"wavrest", "Wm") == [("W", b"wav"), ("m", b"rest")]
    assert ripemd128(b"abc").hex() == "c14a12199c66e4ba84636b0f69144c77"
