"""Writers of dictionary containers and of whole lexicons.

A container is one file by its nature, so each dictionary is written by one
task; dictionaries are written at the same time. What has no such bound is
written as Parquet by :func:`save_lexicon`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.errors import Unsupported
from lexarium.functions.codec import compress_bytes
from lexarium.operators import index as fts
from lexarium.operators import lookup

from . import files

Entries = list[tuple[str, bytes]]
Written = dict[str, bytes]


def stardict(name: str, entries: Entries, synonyms: list[tuple[str, int]] = (), packed: bool = False) -> Written:
    idx, data = bytearray(), bytearray()
    for key, entry in entries:
        idx += key.encode() + b"\0" + struct.pack(">II", len(data), len(entry))
        data += entry
    syn = b"".join(alias.encode() + b"\0" + struct.pack(">I", at) for alias, at in synonyms)
    info = f"StarDict's dict ifo file\nversion=2.4.2\nbookname={name}\nwordcount={len(entries)}\nidxfilesize={len(idx)}\nsametypesequence=m\n"
    if synonyms:
        info += f"synwordcount={len(synonyms)}\n"
    out = {"ifo": info.encode(), "idx": bytes(idx), "dict.dz" if packed else "dict": compress_bytes(bytes(data)) if packed else bytes(data)}
    return out | ({"syn": syn} if synonyms else {})


def dsl(name: str, entries: Entries) -> Written:
    def escape(text: str) -> str:
        return "".join("\\" + c if c in "\\[]{}~@^" else c for c in text)

    lines = [f'#NAME "{name}"', '#INDEX_LANGUAGE "English"', '#CONTENTS_LANGUAGE "English"', ""]
    for key, entry in entries:
        lines += [escape(key), *("\t[m1]" + escape(line) + "[/m]" for line in entry.decode("utf-8", "replace").split("\n"))]
    return {"dsl": ("\n".join(lines) + "\n").encode("utf-16")}


def bgl(name: str, entries: Entries) -> Written:
    body = b"".join(key.encode() + b"\0" + key.encode() + b"\0" + entry + b"\0" for key, entry in entries)
    return {"bglx": b"BGLX" + struct.pack("<IIIQ", 1, len(entries), len(entries), 24) + body}


def zim(name: str, entries: Entries, redirects: list[tuple[str, int]] = (), per_cluster: int = 256, codec: int = 2) -> Written:
    """Entries by url, in their order; redirects (url, number of the article) come after them."""
    clusters, articles = [], []
    for at in range(0, len(entries), per_cluster):
        blobs = [entry for _, entry in entries[at : at + per_cluster]]
        offset, table = 4 * (len(blobs) + 1), []
        for blob in blobs:
            table.append(offset)
            offset += len(blob)
        data = struct.pack(f"<{len(blobs) + 1}I", *table, offset) + b"".join(blobs)
        clusters.append(bytes([codec]) + (zlib.compress(data) if codec == 2 else data))
    for i, (key, _) in enumerate(entries):
        articles.append(struct.pack("<HBcIII", 0, 0, b"A", 0, i // per_cluster, i % per_cluster) + key.encode() + b"\0\0")
    for key, target in redirects:
        articles.append(struct.pack("<HBcII", 0xFFFF, 0, b"A", 0, target) + key.encode() + b"\0\0")
    mimes = b"text/plain\0\0"
    urls = 80 + len(mimes)
    place, pointers = urls + 8 * len(articles) + 8 * len(clusters), []
    for a in articles:
        pointers.append(place)
        place += len(a)
    lists = []
    for c in clusters:
        lists.append(place)
        place += len(c)
    head = b"ZIM\x04" + struct.pack("<HH16sIIQQQQIIQ", 5, 0, b"\0" * 16, len(articles), len(clusters), urls, 0, urls + 8 * len(articles), 80, 0xFFFFFFFF, 0xFFFFFFFF, place)
    tables = struct.pack(f"<{len(pointers)}Q", *pointers) + struct.pack(f"<{len(lists)}Q", *lists)
    return {"zim": head + mimes + tables + b"".join(articles) + b"".join(clusters)}


def mdict(name: str, entries: Entries, per_block: int = 256, encrypted: bool = False, encoding: str = "UTF-8") -> Written:
    """A version 2 file; ``encrypted`` scrambles the key index as such files do."""
    from .formats import MDict
    from .ripemd import ripemd128

    codec, unit = ("utf-16-le", 2) if encoding == "UTF-16" else ("utf-8", 1)
    header = f'<Dictionary GeneratedByEngineVersion="2.0" RequiredEngineVersion="2.0" Encrypted="{2 if encrypted else "No"}" Encoding="{encoding}" Title="{name}" Description="made by a test"/>\r\n\0'.encode("utf-16-le")

    def block(data: bytes) -> bytes:
        return b"\2\0\0\0" + zlib.adler32(data).to_bytes(4, "big") + zlib.compress(data)

    offset, keys, infos, records, table = 0, [], [], [], []
    for at in range(0, len(entries), per_block):
        part, key_data, record = entries[at : at + per_block], b"", b""
        for key, entry in part:
            body = entry.decode("utf-8", "replace").encode(codec) + b"\0" * unit
            key_data += struct.pack(">Q", offset) + key.encode(codec) + b"\0" * unit
            offset += len(body)
            record += body
        packed = block(key_data)
        keys.append(packed)
        edge = b"".join(struct.pack(">H", len(k.encode(codec)) // unit) + k.encode(codec) + b"\0" * unit for k in (part[0][0], part[-1][0]))
        infos.append(struct.pack(">Q", len(part)) + edge + struct.pack(">QQ", len(packed), len(key_data)))
        records.append(block(record))
        table.append(struct.pack(">QQ", len(records[-1]), len(record)))
    info = b"".join(infos)
    packed_info = block(info)
    if encrypted:
        key, out, before = ripemd128(packed_info[4:8] + struct.pack("<I", 0x3695)), bytearray(), 0x36
        for i, byte in enumerate(packed_info[8:]):
            x = byte ^ before ^ (i & 0xFF) ^ key[i % 16]
            before = (x >> 4) | (x << 4) & 0xFF
            out.append(before)
        packed_info = packed_info[:8] + bytes(out)
        assert MDict._decrypt(bytes(out), key)
    head = struct.pack(">QQQQQ", len(keys), len(entries), len(info), len(packed_info), sum(map(len, keys)))
    tail = struct.pack(">QQQQ", len(records), len(entries), sum(map(len, table)), sum(map(len, records)))
    data = struct.pack(">I", len(header)) + header + zlib.adler32(header).to_bytes(4, "little") + head + zlib.adler32(head).to_bytes(4, "big")
    return {"mdx": data + packed_info + b"".join(keys) + tail + b"".join(table) + b"".join(records)}


MAX_CONTAINER = 512 << 20
WRITERS: dict[str, Callable[[str, Entries], Written]] = {"stardict": stardict, "dsl": dsl, "bgl": bgl, "zim": zim, "mdict": mdict}
MAIN = {"stardict": "ifo", "dsl": "dsl", "bgl": "bglx", "zim": "zim", "mdict": "mdx"}


def write_containers(lex: DataFrame, folder: str, format_: str) -> list[str]:
    """Write each dictionary of a lexicon as ``folder/<dict_id>.*``, by key; the main files.

    A dictionary is one file and so one task, which holds it in memory: one of
    more than ``MAX_CONTAINER`` bytes is refused.
    """
    if format_ not in WRITERS:
        raise Unsupported(format_)
    largest = lex.groupBy("dict_id").agg(F.sum(F.octet_length("entry") + F.octet_length("key")).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > MAX_CONTAINER:
        raise Unsupported(f"a dictionary of {largest} bytes in one file; save_lexicon has no such limit")

    def put(table: pa.Table) -> pa.Table:
        name = table.column("dict_id")[0].as_py()
        rows = sorted(zip(table.column("key").to_pylist(), table.column("entry").to_pylist()))
        for tail, data in WRITERS[format_](name, rows).items():
            files.write(f"{folder}/{name}.{tail}", data)
        return pa.table({"file": [f"{folder}/{name}.{MAIN[format_]}"]})

    done = lookup.latest(lex).select("dict_id", "key", "entry").groupBy("dict_id").applyInArrow(put, "file string")
    return sorted(r["file"] for r in done.collect())  # a row for each dictionary


def save_lexicon(lex: DataFrame, path: str, with_index: bool = True) -> None:
    """A lexicon at any size: its entries by key, and its full-text index."""
    lookup.write_sorted(lex, f"{path}/entries")
    if with_index:
        fts.save(fts.build(lex.sparkSession.read.parquet(f"{path}/entries")), f"{path}/index")


def copy_dictionary(source: str, target: str) -> list[str]:
    """Copy a dictionary's file and those beside it that share its stem."""
    base, to = source.rsplit(".", 1)[0], target.rsplit(".", 1)[0]
    out = []
    for f in files.listing(base.rsplit("/", 1)[0]):
        if f.startswith(base + "."):
            files.copy(f, to + f[len(base) :])
            out.append(to + f[len(base) :])
    return out


def remove_dictionary(path: str) -> list[str]:
    base = path.rsplit(".", 1)[0]
    gone = [f for f in files.listing(base.rsplit("/", 1)[0]) if f.startswith(base + ".")]
    for f in gone:
        files.remove(f)
    return gone


def pairs(n: int, spark) -> DataFrame:
    """The entries ``word_000000`` and on, to try things with."""
    key = F.format_string("word_%06d", "id")
    text = F.concat(F.lit("Definition for word "), F.col("id").cast("string"), F.lit(": some words to look up, number after number."))
    return spark.range(n).select(F.lit("generated").alias("dict_id"), F.col("id").alias("ord"), key.alias("key"), F.encode(text, "UTF-8").alias("entry"), text.alias("text"))
