"""Parsers of dictionary containers.

Each format has a class that opens one dictionary from a path and gives its
metadata, the number of its parts (what tasks share out) and the entries of a
part as ``(ordinal, key, bytes, text or None)``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from lexarium.errors import ChecksumMismatch, InvalidFormat, NotFound, Unsupported
from lexarium.functions.codec import Reader, decompress_bytes
from lexarium.functions.encoding import convert, detect

from . import files
from .ripemd import ripemd128

Entry = tuple[int, str, bytes]
MAX_ENTRY, MAX_CLUSTER, MAX_ARTICLE = 4 << 20, 64 << 20, 256 << 10
_EXTENSIONS = {"mdict": "mdict", "mdx": "mdict", "ifo": "stardict", "dict": "stardict", "dz": "stardict", "zim": "zim", "dsl": "dsl", "bglx": "bgl", "bgl": "bgl"}
FORMATS = ("mdict", "stardict", "zim", "dsl", "bgl")
_IFO = b"StarDict's dict"


@dataclass
class Window:
    """Entries from ``start`` to ``end`` and, where it is known, the stretch of the file that tells them."""

    start: int
    end: int
    byte: int | None = None
    stop: int | None = None


def _stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    for tail in (".dict.dz", ".dsl.dz"):
        if name.lower().endswith(tail):
            return name[: -len(tail)]
    return name.rsplit(".", 1)[0]


def sniff(head: bytes) -> str | None:
    """The format that the first 4096 bytes tell, or None."""
    if head.startswith(b"ZIM\x04"):
        return "zim"
    if head.startswith(_IFO):
        return "stardict"
    if head.startswith(b"BGLX"):
        return "bgl"
    if len(head) >= 7 and 0 < int.from_bytes(head[:4], "big") <= 512 << 10 and head[4:7] == b"<\0D":
        return "mdict"
    text = head.lstrip(bytes(range(33)))
    if text.startswith((b"MDict", b"Version")):
        return "mdict"
    marked = head.removeprefix(b"\xef\xbb\xbf").removeprefix(b"\xff\xfe").replace(b"\0", b"")
    return "dsl" if marked.startswith(b"#NAME") else None


def detect_format(path: str) -> str:
    """By extension, else by the first bytes."""
    found = _EXTENSIONS.get(path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower())
    if found and not (found == "stardict" and path.lower().endswith(".dsl.dz")):
        return found
    if path.lower().endswith(".dsl.dz"):
        return "dsl"
    head = files.read(path, 0, 4096)
    if not head:
        raise InvalidFormat(f"{path} is empty")
    found = sniff(head)
    if found is None:
        raise Unsupported(f"{path} is of no known format")
    return found


def is_valid(path: str, format_: str | None = None) -> bool:
    """Whether a file is of a format (any, where none is named), by extension or first bytes."""
    try:
        found = detect_format(path)
    except (NotFound, InvalidFormat, Unsupported):
        return False
    return format_ is None or found == format_


def scan_directory(path: str) -> list[tuple[str, str]]:
    """(file, format) of the dictionaries in a folder; what belongs to another file (.idx, .syn, .dict beside .ifo) is not one."""
    every = files.listing(path)
    ifo = {_stem(f) for f in every if f.lower().endswith(".ifo")}
    out = []
    for f in every:
        low = f.lower()
        if low.endswith((".idx", ".idx.gz", ".syn", ".syn.gz", ".idx.dz", ".syn.dz")) or (low.endswith((".dict", ".dict.dz")) and _stem(f) in ifo):
            continue
        if is_valid(f):
            out.append((f, detect_format(f)))
    return out


class StarDict:
    """An .ifo with its .idx, .dict and .syn. Of keys that repeat the last is the entry; synonyms never replace a key.

    With a ``window`` from :meth:`cuts` only that stretch of the .idx is read.
    """

    def __init__(self, path: str, window: Window | None = None):
        low = path.lower()
        base = path[: -len(".dict.dz")] if low.endswith(".dict.dz") else path.rsplit(".", 1)[0]
        self.path = path if low.endswith(".ifo") else self._find(base, ("ifo",))
        self.base = self.path.rsplit(".", 1)[0]
        self.info = self._ifo(files.read(self.path))
        self.dict_path = self._find(self.base, ("dict", "dict.dz"))
        idx_path = self._find(self.base, ("idx", "idx.gz", "idx.dz"))
        idx = files.read(idx_path, window.byte, window.stop - window.byte) if window else self._packed(idx_path)
        self.first = window.start if window else 0
        self.places: list[tuple[str, int, int]] = []
        self.bytes: list[int] | None = None if idx_path.lower().endswith(("gz", "dz")) else []
        at = 0
        while (end := idx.find(b"\0", at)) >= 0 and end + 9 <= len(idx):
            self.places.append((idx[at:end].decode("utf-8", "replace"), *struct.unpack_from(">II", idx, end + 1)))
            if self.bytes is not None:
                self.bytes.append(at)
            at = end + 9
        self.size = at
        self.synonyms: list[tuple[str, int]] = []
        if window:
            return
        try:
            syn = self._packed(self._find(self.base, ("syn", "syn.gz", "syn.dz")))
        except NotFound:
            syn = b""
        at = 0
        while (end := syn.find(b"\0", at)) >= 0 and end + 5 <= len(syn):
            self.synonyms.append((syn[at:end].decode("utf-8", "replace"), struct.unpack_from(">I", syn, end + 1)[0]))
            at = end + 5

    @staticmethod
    def _find(base: str, tails: tuple[str, ...]) -> str:
        for tail in tails:
            for name in (f"{base}.{tail}", f"{base}.{tail.upper()}"):
                if files.exists(name):
                    return name
        raise NotFound(f"{base}.{tails[0]}")

    @staticmethod
    def _packed(path: str) -> bytes:
        data = files.read(path)
        return decompress_bytes(data, "gzip") if data[:2] == b"\x1f\x8b" else data

    @staticmethod
    def _ifo(data: bytes) -> dict[str, str]:
        lines = data.decode("utf-8", "replace").lstrip("\ufeff").splitlines()
        if not lines or not lines[0].startswith(_IFO.decode()):
            raise InvalidFormat("no StarDict .ifo")
        if len(lines) < 2 or not lines[1].startswith("version="):
            raise InvalidFormat("an .ifo without version")
        info = dict(line.split("=", 1) for line in lines[1:] if "=" in line)
        for number in ("wordcount", "synwordcount", "idxfilesize"):
            if number in info and not info[number].strip().isdigit():
                raise InvalidFormat(f"{number}={info[number]}")
        if info.get("idxoffsetbits", "32").strip() == "64":
            raise Unsupported("64-bit offsets")
        if info.get("dicttype", "").strip():
            raise Unsupported(f"dicttype {info['dicttype']}")
        return info

    def metadata(self) -> dict:
        i = self.info
        return {"name": i.get("bookname") or _stem(self.path), "version": i["version"], "entries": len({k for k, _, _ in self.places}), "description": i.get("description"), "author": i.get("author"), "created": i.get("date"), "language": None, "file_size": files.size(self.dict_path)}

    def rows(self) -> int:
        return len(self.places) + len(self.synonyms)

    def cuts(self, step: int) -> list[Window]:
        """Stretches of ``step`` entries; those of synonyms need the whole index."""
        n = len(self.places)
        out = []
        for at in range(0, n, step):
            end = min(at + step, n)
            out.append(Window(at, end, self.bytes[at], self.bytes[end] if end < n else self.size) if self.bytes is not None else Window(at, end))
        return out + [Window(at, min(at + step, self.rows())) for at in range(n, self.rows(), step)]

    def entries(self, start: int, end: int) -> Iterator[Entry]:
        """Entries by ordinal: those of the index, then synonyms that are no key."""
        start, end = start - self.first, end - self.first
        data, low = (self._packed(self.dict_path) if self.dict_path.lower().endswith(".dz") else None), 0

        def body(offset: int, size: int) -> bytes:
            raw = files.read(self.dict_path, offset, size) if data is None or offset < low or offset + size > low + len(data) else data[offset - low : offset - low + size]
            if len(raw) < size:
                raise InvalidFormat(f"entry at {offset} ends beyond the data")
            return raw

        own = self.places[start:end]
        if data is None and len(own) > 64:
            # entries mostly lie in the order of their keys, so one stretch has them all
            low, high = min(o for _, o, _ in own), max(o + n for _, o, n in own)
            if high - low <= 4 * sum(n for _, _, n in own) + (1 << 20):
                data = files.read(self.dict_path, low, high - low)
        for at, (key, offset, size) in enumerate(own, start):
            yield at + self.first, key, body(offset, size)
        if end > len(self.places):
            known = {k for k, _, _ in self.places}
            seen: dict[str, int] = {}
            for n, (alias, _) in enumerate(self.synonyms):
                seen.setdefault(alias, n)
            for at in range(max(start, len(self.places)), min(end, self.rows())):
                n = at - len(self.places)
                alias, target = self.synonyms[n]
                if alias not in known and seen[alias] == n and target < len(self.places):
                    yield at, alias, body(*self.places[target][1:])


def decode_dsl(data: bytes) -> str:
    if data[:2] == b"\x1f\x8b":
        data = decompress_bytes(data, "gzip")
    for mark, codec in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace")
    head = data[:4096]
    if len(head) > 3 and head[1::2].count(0) > len(head) // 4:
        return data.decode("utf-16-le", "replace")
    if len(head) > 3 and head[0::2].count(0) > len(head) // 4:
        return data.decode("utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return convert(data, detect(data))


_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_COMMENT = re.compile(r"\{\{.*?\}\}", re.S)
_TAG = re.compile(r"\\(.)|\[(/?)([^\[\]\s]*)[^\[\]]*\]", re.S)


def dsl_tags(body: str) -> dict:
    """What the tags of a card tell: media, transcription, margins. An escaped bracket is no tag; ``[/m]`` closes any margin."""
    margins: list[str] = []
    out = {"has_media": False, "has_transcription": False, "margin_tags": margins, "plain": ""}
    plain, last = [], 0
    for m in _TAG.finditer(body):
        plain.append(body[last : m.start()])
        last = m.end()
        if m.group(1) is not None:
            plain.append(m.group(1))
            continue
        name = m.group(3).lower()
        if not m.group(2):
            out["has_media"] |= name == "s"
            out["has_transcription"] |= name == "t"
            if re.fullmatch(r"m\d?", name) and name not in margins:
                margins.append(name)
    plain.append(body[last:])
    out["plain"] = "".join(plain)
    return out


class Dsl:
    """Cards of a DSL file. ``strict``: indented lines are bodies, and headwords in a row share the body that follows.

    Not strict: every line that begins with none of ``# [ {`` is a headword,
    and one without a body is dropped.
    """

    def __init__(self, path: str, strict: bool = True, window: Window | None = None):
        self.path, self.strict, self.window = path, strict, window
        self.header: dict[str, str] = {}

    @cached_property
    def cards(self) -> list[tuple[str, str]]:
        w = self.window
        if w is None or w.byte is None:
            return self._parse(decode_dsl(files.read(self.path)))
        return self._parse(files.read(self.path, w.byte, w.stop - w.byte).decode(dict(_MARKS)[self._mark()], "replace"))

    def _mark(self) -> bytes:
        head = files.read(self.path, 0, 3)
        return next((mark for mark, _ in _MARKS if head.startswith(mark)), b"")

    def stretches(self, step: int) -> list[Window]:
        """Stretches of about ``step`` bytes, read one after the other; none where the first bytes do not tell the encoding, or not all bytes are of it.

        One ends before a headword that follows a body, outside comments, so
        that it is parsed alone as it is within the whole.
        """
        mark, size, out, rows = self._mark(), files.size(self.path), [], 0
        if not mark:
            return []
        codec, at, length = dict(_MARKS)[mark], len(mark), step
        while at < size:
            length += length % 2
            data = files.read(self.path, at, min(length, size - at))
            text = data.decode(codec, "replace")
            if at + len(data) < size:
                end = self._cut(text)
                if not end:
                    length *= 2
                    continue
                text = text[:end]
                head = text.encode(codec, "replace")
                if not data.startswith(head):
                    return []
                data = data[: len(head)]
            n = len(self._parse(text))
            out.append(Window(rows, rows + n, at, at + len(data)))
            rows, at, length = rows + n, at + len(data), step
        return out

    def _cut(self, text: str) -> int:
        """The last place in ``text`` where a stretch may end, 0 if there is none."""
        spans = [m.span() for m in _COMMENT.finditer(text)]
        limit = text.find("{{", spans[-1][1] if spans else 0)
        end = len(text) if limit < 0 else limit
        while (end := text.rfind("\n", 0, end)) > 0:
            at = end + 1
            while spans and spans[-1][0] >= at:
                spans.pop()
            if at >= len(text) or text[at].isspace() or text[at] in "#[{":
                continue
            begin = text.rfind("\n", 0, end) + 1
            if spans and spans[-1][1] > begin:
                continue
            before = text[begin:end]
            if not self.strict or before[:1] in (" ", "\t") and before.strip() and len(before.splitlines()) == 1:
                return at
        return 0

    @staticmethod
    def headword(line: str) -> str:
        return re.sub(r"\s+", " ", re.sub(r"\\(.)", r"\1", re.sub(r"\{\{.*?\}\}", "", line))).strip()

    def _parse(self, text: str) -> list[tuple[str, str]]:
        cards: list[tuple[str, str]] = []
        heads: list[str] = []
        body: list[str] = []

        def flush() -> None:
            nonlocal heads, body
            joined = "\n".join(body)
            if body:
                cards.extend((h, joined) for h in heads if h)
            heads, body = [], []

        for line in _COMMENT.sub("", text).splitlines():
            bare = line.strip()
            if line.startswith("#"):
                name, _, value = line[1:].partition(" ")
                self.header[name.strip().upper()] = value.strip().strip('"')
                continue
            if not bare:
                continue
            inside = line[:1] in (" ", "\t") if self.strict else bare[0] in "[{"
            if inside:
                body.append(bare)
            else:
                if body or not self.strict:
                    flush()
                heads.append(self.headword(line))
        flush()
        return cards

    def metadata(self) -> dict:
        entries, h = len({k for k, _ in self.cards}), self.header
        return {"name": h.get("NAME") or _stem(self.path), "version": None, "entries": entries, "description": None, "author": None, "created": None, "language": h.get("CONTENTS_LANGUAGE") or h.get("INDEX_LANGUAGE"), "file_size": files.size(self.path)}

    def rows(self) -> int:
        return len(self.cards)

    def entries(self, start: int, end: int) -> Iterator[Entry]:
        first = self.window.start if self.window and self.window.byte is not None else 0
        for at in range(max(start, first), min(end, first + len(self.cards))):
            yield at, self.cards[at - first][0], self.cards[at - first][1].encode()


class Bgl:
    """An index file ``BGLX``: a header and articles of three strings each. Raw .bgl files are not read."""

    def __init__(self, path: str, window: Window | None = None):
        self.window = window
        if not path.lower().endswith((".bglx", ".idx")):
            for tail in (".bglx", ".idx"):
                if files.exists(path.rsplit(".", 1)[0] + tail):
                    path = path.rsplit(".", 1)[0] + tail
                    break
        self.path = path
        head = Reader(files.read(path, 0, 24))
        if head.take(4) != b"BGLX":
            raise InvalidFormat("no BGLX index")
        self.version, self.articles, self.words, self.offset = head.number(4), head.number(4), head.number(4), head.number(8)

    def metadata(self) -> dict:
        return {"name": _stem(self.path), "version": str(self.version), "entries": self.articles, "description": None, "author": None, "created": None, "language": None, "file_size": files.size(self.path)}

    def rows(self) -> int:
        return self.articles

    def cuts(self, step: int) -> list[Window]:
        """Stretches of ``step`` articles, told by the ends of their strings."""
        ends = np.flatnonzero(np.frombuffer(files.read(self.path, self.offset), np.uint8) == 0)[2::3] + 1 + self.offset
        if len(ends) < self.articles:
            raise InvalidFormat("the articles end early")
        starts = [self.offset, *ends[: self.articles].tolist()]
        return [Window(at, min(at + step, self.articles), starts[at], starts[min(at + step, self.articles)]) for at in range(0, self.articles, step)]

    def entries(self, start: int, end: int) -> Iterator[Entry]:
        window = self.window
        reader = Reader(files.read(self.path, window.byte, window.stop - window.byte) if window else files.read(self.path, self.offset))
        for at in range(window.start if window else 0, min(end, self.articles)):
            begin = reader.at
            key, _, body = reader.until(), reader.until(), reader.until()
            if reader.at - begin > MAX_ARTICLE:
                raise InvalidFormat(f"article {at} is too long")
            if at >= start:
                yield at, key.decode("utf-8", "replace"), body


class Zim:
    """Articles of an archive by their url; redirects have the entry of their target, chains and all."""

    _CODECS = {0: "none", 1: "none", 2: "zlib", 3: "bz2", 4: "xz", 5: "zstd"}

    def __init__(self, path: str):
        self.path = path
        head = Reader(files.read(path, 0, 80))
        if head.take(4) != b"ZIM\x04":
            raise InvalidFormat("no ZIM archive")
        self.major, _, _ = head.number(2), head.number(2), head.take(16)
        self.count, self.clusters = head.number(4), head.number(4)
        self.urls, _, self.cluster_list, self.mimes = (head.number(8) for _ in range(4))
        self.main, _, self.end = head.number(4), head.number(4), head.number(8)
        if self.urls + 8 * self.count > files.size(path) or self.cluster_list + 8 * self.clusters > files.size(path):
            raise InvalidFormat("tables beyond the end of the file")

    def mime_types(self) -> list[str]:
        reader, out = Reader(files.read(self.path, self.mimes, 1 << 16)), []
        while name := reader.until():
            out.append(name.decode("utf-8", "replace"))
        return out

    def metadata(self) -> dict:
        return {"name": _stem(self.path), "version": str(self.major), "entries": self.count, "description": None, "author": None, "created": None, "language": None, "file_size": files.size(self.path)}

    def rows(self) -> int:
        return self.count

    def _pointers(self, at: int, n: int) -> tuple[int, ...]:
        return struct.unpack(f"<{n}Q", files.read(self.path, at, 8 * n))

    def _article(self, place: int) -> dict:
        reader = Reader(files.read(self.path, place, 4096))
        mime, extra, space, _ = reader.number(2), reader.number(1), reader.take(1), reader.number(4)
        if mime == 0xFFFF:
            out = {"redirect": reader.number(4)}
        elif mime >= 0xFFFD:
            return {"space": space.decode("latin-1"), "url": ""}
        else:
            out = {"cluster": reader.number(4), "blob": reader.number(4)}
        del extra
        url, title = reader.until(), reader.until()
        return out | {"space": space.decode("latin-1"), "url": url.decode("utf-8", "replace"), "title": title.decode("utf-8", "replace"), "mime": mime}

    def resolve(self, number: int) -> dict | None:
        """The article that a number stands for in the end; None for circles and numbers out of range."""
        seen: set[int] = set()
        while number not in seen and number < self.count:
            seen.add(number)
            article = self._article(self._pointers(self.urls + 8 * number, 1)[0])
            if "redirect" not in article:
                return article if "cluster" in article else None
            number = article["redirect"]
        return None

    def cluster(self, number: int) -> list[bytes]:
        if number >= self.clusters:
            raise InvalidFormat(f"cluster {number} of {self.clusters}")
        start = self._pointers(self.cluster_list + 8 * number, 1)[0]
        end = self._pointers(self.cluster_list + 8 * number + 8, 1)[0] if number + 1 < self.clusters else self.end or files.size(self.path)
        raw = files.read(self.path, start, max(0, min(end, files.size(self.path)) - start))
        if not raw:
            raise InvalidFormat(f"cluster {number} is empty")
        codec = self._CODECS.get(raw[0] & 15)
        if codec is None:
            raise Unsupported(f"cluster codec {raw[0] & 15}")
        data = decompress_bytes(raw[1:], codec, MAX_CLUSTER) if codec != "none" else raw[1:]
        wide = 8 if raw[0] & 16 and self.major >= 6 else 4
        first = int.from_bytes(data[:wide], "little")
        if first % wide or first > len(data) or first < wide:
            raise InvalidFormat(f"offsets of cluster {number}")
        offsets = [int.from_bytes(data[i : i + wide], "little") for i in range(0, first, wide)]
        if any(x > y for x, y in zip(offsets, offsets[1:])) or offsets[-1] > len(data):
            raise InvalidFormat(f"offsets of cluster {number}")
        return [data[x:y] for x, y in zip(offsets, offsets[1:])]

    def entries(self, start: int, end: int) -> Iterator[Entry]:
        end = min(end, self.count)
        if start >= end:
            return
        wanted: dict[int, list[tuple[int, str, int]]] = {}
        for at, place in enumerate(self._pointers(self.urls + 8 * start, end - start), start):
            article = self._article(place)
            target = self.resolve(at) if "redirect" in article else article
            if target is not None and "cluster" in target:
                wanted.setdefault(target["cluster"], []).append((at, article["url"], target["blob"]))
        for number, items in sorted(wanted.items()):
            blobs = self.cluster(number)
            for at, url, blob in items:
                if blob >= len(blobs):
                    raise InvalidFormat(f"blob {blob} of cluster {number}")
                yield at, url, blobs[blob]


class MDict:
    """An .mdx file of version 1 or 2; a part is one record block."""

    def __init__(self, path: str):
        self.path = path
        size = int.from_bytes(files.read(path, 0, 4), "big")
        if not 0 < size <= 512 << 10:
            raise InvalidFormat("no MDict header")
        raw = files.read(path, 4, size + 4)
        if len(raw) < size + 4:
            raise InvalidFormat("the header ends early")
        if zlib.adler32(raw[:size]) != int.from_bytes(raw[size:], "little"):
            raise ChecksumMismatch("header")
        self.attributes = dict(re.findall(r'(\w+)\s*=\s*"([^"]*)"', raw[:size].decode("utf-16-le", "replace"), re.S))
        if not self.attributes:
            raise InvalidFormat("no attributes in the header")
        try:
            self.version = float(self.attributes.get("GeneratedByEngineVersion", "2.0"))
        except ValueError as e:
            raise InvalidFormat("version") from e
        if self.version >= 3:
            raise Unsupported(f"version {self.version}")
        self.wide = 8 if self.version >= 2 else 4
        name = self.attributes.get("Encoding", "").upper()
        self.codec = "utf-16-le" if name in ("", "UTF-16") else "gb18030" if name in ("GBK", "GB2312") else name.lower()
        self.encrypted = {"": 0, "No": 0, "Yes": 1}.get(self.attributes.get("Encrypted", ""), None)
        if self.encrypted is None:
            self.encrypted = int(self.attributes["Encrypted"]) if self.attributes["Encrypted"].isdigit() else 0
        if self.encrypted & 1:
            raise Unsupported("records that need a user's key")
        self._keys(4 + size + 4)

    def _block(self, data: bytes, size: int) -> bytes:
        kind, check = data[:4], int.from_bytes(data[4:8], "big")
        if kind == b"\0\0\0\0":
            out = data[8:]
        elif kind == b"\2\0\0\0":
            out = decompress_bytes(data[8:], "zlib", max(size, 1))
        elif kind == b"\1\0\0\0":
            out = decompress_bytes(data[8:], "lzo", max(size, 1))
        else:
            raise InvalidFormat(f"block type {kind.hex()}")
        if len(out) != size:
            raise InvalidFormat(f"a block of {len(out)} bytes, not {size}")
        if zlib.adler32(out) != check:
            raise ChecksumMismatch("block")
        return out

    def _keys(self, at: int) -> None:
        numbers = 5 if self.version >= 2 else 4
        head = Reader(files.read(self.path, at, numbers * self.wide + 4))
        blocks, self.count = head.number(self.wide, "big"), head.number(self.wide, "big")
        plain = head.number(self.wide, "big") if self.version >= 2 else 0
        info_size, keys_size = head.number(self.wide, "big"), head.number(self.wide, "big")
        at += numbers * self.wide
        if self.version >= 2:
            if zlib.adler32(head.data[: numbers * self.wide]) != int.from_bytes(head.take(4), "big"):
                raise ChecksumMismatch("key header")
            at += 4
        info = files.read(self.path, at, info_size)
        if self.version >= 2:
            if self.encrypted & 2:
                info = info[:8] + self._decrypt(info[8:], ripemd128(info[4:8] + struct.pack("<I", 0x3695)))
            info = self._block(info, plain)
        self.key_blocks: list[tuple[int, int, int]] = []
        reader, place = Reader(info), at + info_size
        unit = 2 if self.codec == "utf-16-le" else 1
        for _ in range(blocks):
            reader.number(self.wide, "big")
            for _ in range(2):
                n = reader.number(2, "big") if self.version >= 2 else reader.number(1)
                reader.take((n + (1 if self.version >= 2 else 0)) * unit)
            packed, size = reader.number(self.wide, "big"), reader.number(self.wide, "big")
            self.key_blocks.append((place, packed, size))
            place += packed
        at += info_size + keys_size
        head = Reader(files.read(self.path, at, 4 * self.wide))
        count, _, table, _ = (head.number(self.wide, "big") for _ in range(4))
        reader = Reader(files.read(self.path, at + 4 * self.wide, table))
        place, shadow = at + 4 * self.wide + table, 0
        self.records: list[tuple[int, int, int, int]] = []
        for _ in range(count):
            packed, size = reader.number(self.wide, "big"), reader.number(self.wide, "big")
            self.records.append((place, packed, size, shadow))
            place, shadow = place + packed, shadow + size
        self.total = shadow

    @staticmethod
    def _decrypt(data: bytes, key: bytes) -> bytes:
        out, before = bytearray(), 0x36
        for i, byte in enumerate(data):
            out.append(((byte >> 4) | (byte << 4) & 0xFF) ^ before ^ (i & 0xFF) ^ key[i % len(key)])
            before = byte
        return bytes(out)

    def keys(self) -> list[tuple[int, str]]:
        """(offset in the unpacked records, key) of all headwords, in the order of the file."""
        out: list[tuple[int, str]] = []
        end = b"\0\0" if self.codec == "utf-16-le" else b"\0"
        for place, packed, size in self.key_blocks:
            data = self._block(files.read(self.path, place, packed), size)
            at = 0
            while at < len(data):
                offset = int.from_bytes(data[at : at + self.wide], "big")
                at += self.wide
                stop = data.find(end, at)
                while stop >= 0 and len(end) == 2 and (stop - at) % 2:
                    stop = data.find(end, stop + 1)
                if stop < 0:
                    raise InvalidFormat("a key without end")
                out.append((offset, data[at:stop].decode(self.codec, "replace")))
                at = stop + len(end)
        return out

    def metadata(self) -> dict:
        a = self.attributes
        title = self.attributes.get("Title", "")
        return {"name": title if len(title) >= 5 else _stem(self.path), "version": str(self.version), "entries": self.count, "description": a.get("Description"), "author": None, "created": a.get("CreationDate"), "language": a.get("DictCharset") or a.get("Encoding"), "file_size": files.size(self.path), "right_to_left": a.get("Left2Right", "Yes") != "Yes"}

    def rows(self) -> int:
        return len(self.records)

    def entries(self, start: int, end: int) -> Iterator[Entry]:
        """Entries whose text begins in the record blocks from ``start`` to ``end``."""
        keys = self.keys()
        places = sorted({o for o, _ in keys} | {self.total})
        after = dict(zip(places, places[1:]))
        at = 0
        order = sorted(range(len(keys)), key=lambda i: keys[i][0])
        blocks: dict[int, bytes] = {}

        def block(i: int) -> bytes:
            if i not in blocks:
                blocks.clear()
                place, packed, size, _ = self.records[i]
                blocks[i] = self._block(files.read(self.path, place, packed), size)
            return blocks[i]

        for i in range(start, min(end, len(self.records))):
            _, _, size, shadow = self.records[i]
            while at < len(order) and keys[order[at]][0] < shadow:
                at += 1
            while at < len(order) and keys[order[at]][0] < shadow + size:
                offset, key = keys[order[at]]
                stop = after[offset]
                if stop - offset > MAX_ENTRY:
                    raise InvalidFormat(f"entry of {stop - offset} bytes")
                raw, j = b"", i
                while j < len(self.records) and self.records[j][3] < stop:
                    base = self.records[j][3]
                    raw += block(j)[max(offset - base, 0) : stop - base]
                    j += 1
                yield order[at], key, raw.decode(self.codec, "replace").rstrip("\0").encode()
                at += 1


OPENERS = {"stardict": StarDict, "dsl": Dsl, "bgl": Bgl, "zim": Zim, "mdict": MDict}


def open_dictionary(path: str, format_: str | None = None, strict: bool = True, window: Window | None = None):
    kind = format_ or detect_format(path)
    if kind not in OPENERS:
        raise Unsupported(kind)
    if not files.exists(path):
        raise NotFound(path)
    try:
        if kind == "dsl":
            return Dsl(path, strict, window)
        if window is not None and window.byte is not None:
            return OPENERS[kind](path, window)
        return OPENERS[kind](path)
    except struct.error as e:
        raise InvalidFormat(str(e)) from e
