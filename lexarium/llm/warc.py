"""Operator 2: a WARC source, and a writer to make archives of pages.

``spark.read.format("warc")`` plans one partition for each group of files of
about ``partitionBytes``; a larger compressed file is read in ranges that begin
at gzip members. Predicates on the record type and the other header
columns go into the reader, as the option ``where`` or, with the option
``pushdown`` "true", from the filters of the query. (Spark 4.1 keeps the filters
it pushed into a Python source with the relation, and a second query over the
same DataFrame would see those of the first; so a DataFrame read with
``pushdown`` is good for one query, and :func:`read_warc` uses ``where``.) It parses a record's header block first,
and of records that fail only looks for their end (plain files are read on
after the payload without touching it; a gzip member has to be inflated, but is
neither kept nor parsed). With ``payload`` "false" no payload is decoded at all.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from .store import new_path

SCHEMA = (
    "warc_type string, record_id string, date string, target_uri string, content_type string, content_length bigint, headers map<string,string>, "
    "http_status int, http_headers map<string,string>, payload binary, file string, offset bigint"
)
_ARROW = pa.schema(
    [
        ("warc_type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()),
    ]
)
_HEADER_OF = {"warc_type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "target_uri": "warc-target-uri", "content_type": "content-type", "content_length": "content-length"}
_KINDS = {"startswith": StringStartsWith, "endswith": StringEndsWith, "contains": StringContains, ">": GreaterThan, ">=": GreaterThanOrEqual, "<": LessThan, "<=": LessThanOrEqual}
_READ = 1 << 20
#: No block of stored bytes in a gzip member is longer.
_STORED = 1 << 16
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 4096
MAX_HEADER = 1 << 20


class WarcError(ValueError):
    """The bytes are no WARC record."""


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


def _headers(block: bytes) -> dict[str, str]:
    """Header lines with lower-case names; a folded line goes on with the last one, of repeated names the last counts."""
    out: dict[str, str] = {}
    name = ""
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _chain(raw, at: int, size: int) -> bool:
    """Whether gzip members that each begin a record follow one another from ``at`` on, for ``_STORED`` bytes or to the end."""
    end = min(at + _STORED, size)
    while at < end:
        raw.seek(at)
        member, head = zlib.decompressobj(31), b""
        try:
            while not member.eof:
                data = raw.read(_STORED)
                if not data:
                    return False
                head += member.decompress(data)[: 5 - len(head)]
        except zlib.error:
            return False
        if head != b"WARC/":
            return False
        at = raw.tell() - len(member.unused_data)
    return True


def member_start(raw, at: int, size: int) -> int:
    """The first place from ``at`` on where a range of a compressed file may begin; its end where there is none.

    What looks like members may be an archive inside a payload: data that do
    not compress are stored as they are, but never more than ``_STORED`` bytes
    in a row, so a longer chain is one of the file itself.
    """
    if at <= 0:
        return 0
    while at < size:
        raw.seek(at)
        data = raw.read(_READ + 2)
        i = data.find(b"\x1f\x8b\x08")
        while 0 <= i:
            if _chain(raw, at + i, size):
                return at + i
            i = data.find(b"\x1f\x8b\x08", i + 1)
        at += _READ
    return size


class _Source:
    """Bytes of one file: of a plain file, or of one gzip member after another, from ``start`` to what begins at ``stop``."""

    def __init__(self, raw, gzip: bool, size: int, start: int = 0, stop: int | None = None):
        self.raw, self.gzip, self.size = raw, gzip, size
        self.stop = size if stop is None else stop
        self.raw.seek(start)
        self.buffer, self.at, self.made = b"", 0, 0
        self.members: list[tuple[int, int]] = []  # (where its bytes begin, where it lies in the file)
        self.member, self.rest = None, b""
        self.ended = False

    def _more(self) -> bytes:
        if not self.gzip:
            return self.raw.read(_READ)
        while True:
            if self.member is None or self.member.eof:
                if self.member is not None:
                    self.rest = self.member.unused_data
                data = self.rest or self.raw.read(_READ)
                self.rest = b""
                place = self.raw.tell() - len(data)
                if not data or place >= self.stop:
                    self.rest = data
                    return b""
                self.members.append((self.made, place))
                self.member = zlib.decompressobj(31)
                out = self.member.decompress(data)
            else:
                data = self.raw.read(_READ)
                if not data:
                    raise WarcError("the file ends inside a gzip member")
                out = self.member.decompress(data)
            if out:
                self.made += len(out)
                return out

    def place(self, at: int) -> int:
        """Where the byte ``at`` lies in a plain file, or the gzip member that begins with it or holds it."""
        if not self.gzip:
            return at
        while len(self.members) > 1 and self.members[1][0] <= at:
            self.members.pop(0)
        return self.members[0][1]

    def until(self, mark: bytes, most: int) -> bytes | None:
        """Bytes up to ``mark``, which is consumed; None at the end."""
        seen = 0
        while (i := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if seen > most:
                raise WarcError("no end of a header block")
            more = self._more()
            if not more:
                if self.buffer.strip():
                    raise WarcError("the file ends inside a header block")
                return None
            self.buffer += more
        out, self.buffer = self.buffer[:i], self.buffer[i + len(mark) :]
        self.at += i + len(mark)
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next ``n`` bytes, or nothing but the step over them."""
        self.at += n
        if len(self.buffer) >= n:
            out, self.buffer = self.buffer[:n] if keep else b"", self.buffer[n:]
            return out
        if not keep and not self.gzip:
            n -= len(self.buffer)
            self.buffer = b""
            if self.raw.tell() + n > self.size:
                raise WarcError("the file ends inside a payload")
            self.raw.seek(self.raw.tell() + n)
            return b""
        parts, have = [self.buffer] if keep else [], len(self.buffer)
        while have < n:
            more = self._more()
            if not more:
                raise WarcError("the file ends inside a payload")
            have += len(more)
            last = more
            if keep:
                parts.append(more)
        over = have - n
        self.buffer = last[len(last) - over :] if over else b""
        data = b"".join(parts)
        return data[: len(data) - over] if keep else b""


def _passes(filters: list[Filter], values: dict) -> bool:
    for f in filters:
        v = values.get(f.attribute[0])
        if v is None:
            return False
        if isinstance(f, EqualTo):
            ok = v == f.value
        elif isinstance(f, In):
            ok = v in f.value
        elif isinstance(f, StringStartsWith):
            ok = v.startswith(f.value)
        elif isinstance(f, StringEndsWith):
            ok = v.endswith(f.value)
        elif isinstance(f, StringContains):
            ok = f.value in v
        elif isinstance(f, GreaterThan):
            ok = v > f.value
        elif isinstance(f, GreaterThanOrEqual):
            ok = v >= f.value
        elif isinstance(f, LessThan):
            ok = v < f.value
        elif isinstance(f, LessThanOrEqual):
            ok = v <= f.value
        else:  # IsNotNull
            ok = True
        if not ok:
            return False
    return True


def records(raw, gzip: bool, size: int, filters: list[Filter], payload: bool, name: str, start: int = 0, stop: int | None = None) -> Iterator[dict]:
    """The records of one file, or of a range of a compressed one, that pass; the offset of a compressed record is that of its gzip member."""
    source = _Source(raw, gzip, size, start, stop)
    while True:
        start = source.at
        block = source.until(b"\r\n\r\n", MAX_HEADER)
        if block is None:
            return
        lead = len(block) - len(block.lstrip(b"\r\n"))
        block = block[lead:]
        if not block:
            continue
        if not block.startswith(b"WARC/"):
            raise WarcError(f"no WARC record at {start + lead} of {name}")
        headers = _headers(block)
        length = headers.get("content-length", "")
        if not length.isdigit():
            raise WarcError(f"no length at {start + lead} of {name}")
        values = {c: headers.get(h) for c, h in _HEADER_OF.items()}
        values["content_length"] = int(length)
        if not _passes(filters, values):
            source.take(int(length), False)
            continue
        body = source.take(int(length), payload)
        status, http = None, None
        if payload and (values["content_type"] or "").startswith("application/http"):
            head, mark, rest = body.partition(b"\r\n\r\n")
            if mark:
                first = head.split(b"\r\n", 1)[0].split(b" ")
                status = int(first[1]) if head.startswith(b"HTTP/") and len(first) > 1 and first[1].isdigit() else None
                http, body = _headers(head), rest
        yield values | {"headers": headers, "http_status": status, "http_headers": http, "payload": body if payload else None, "file": name, "offset": source.place(start + lead) if gzip else start + lead}


@dataclass
class WarcFiles(InputPartition):
    files: list[tuple[str, int, int, int]]  # path, size, and the range to read


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", 128 << 20))
        self.filters: list[Filter] = []
        for column, value in json.loads(options.get("where", "{}")).items():
            if column not in _HEADER_OF:
                raise ValueError(f"{column} is no header column")
            if isinstance(value, dict):
                self.filters += [_KINDS[kind]((column,), x) for kind, x in value.items()]
            else:
                self.filters.append(In((column,), tuple(value)) if isinstance(value, list) else EqualTo((column,), value))

    def partitions(self) -> list[WarcFiles]:
        found: list[tuple[str, int]] = []
        for path in self.paths:
            fs, at = open_fs(path)
            info = fs.get_file_info(at)
            base = path[: len(path) - len(at)] if path.endswith(at) else "file://"
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            infos = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
            found += [(base + i.path, i.size) for i in infos if i.is_file and i.path.endswith((".warc", ".warc.gz"))]
        groups: list[WarcFiles] = []
        room = 0
        for name, size in sorted(found):
            # a compressed file may begin at any member; a plain one has no mark that its payloads cannot have too
            step = self.partition_bytes if name.endswith(".gz") else max(size, 1)
            for start in range(0, max(size, 1), step):
                end = min(start + step, size)
                if end - start > room or not groups:
                    groups.append(WarcFiles([]))
                    room = self.partition_bytes
                groups[-1].files.append((name, size, start, end))
                room -= end - start
        return groups or [WarcFiles([])]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {c: [] for c in _ARROW.names}
        weight = count = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)

        for name, size, begin, end in partition.files:
            fs, at = open_fs(name)
            with fs.open_input_file(at) as raw:
                gzip = name.endswith(".gz")
                start, stop = (member_start(raw, begin, size), member_start(raw, end, size) if end < size else size) if gzip else (0, size)
                for row in records(raw, gzip, size, self.filters, self.payload, name, start, stop) if start < stop else ():
                    for c, held in columns.items():
                        x = row[c]
                        held.append(list(x.items()) if isinstance(x, dict) else x)
                    weight += len(row["payload"] or b"") + 512
                    count += 1
                    if weight > _BATCH_BYTES or count >= _BATCH_ROWS:
                        yield batch()
                        columns, weight, count = {c: [] for c in _ARROW.names}, 0, 0
        if count:
            yield batch()


class PushingWarcReader(WarcReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = (EqualTo, In, IsNotNull, *_KINDS.values())
        for f in filters:
            if isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in _HEADER_OF:
                self.filters.append(f)
            else:
                yield f


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushingWarcReader if options.get("pushdown") == "true" else WarcReader)(options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, where: dict | None = None) -> DataFrame:
    """The records under ``path`` (files or folders, parted by commas). Header names are lower-case; what a record lacks is null.

    ``where`` maps header columns to a value, a list of values or
    ``{"startswith" | "endswith" | "contains" | ">" | ">=" | "<" | "<=": value}``;
    a record without the header fails. Bytes that are no record raise
    :class:`WarcError`; empty files have no rows.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("where", json.dumps(where or {})).load(path)


def _record(kind: str, headers: dict[str, str | None], body: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, html: str | None) -> list[bytes]:
    """A request and a response record of one page; a null html is a response without an HTTP message."""
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": uri, "X-Page-Id": None if page_id is None else str(page_id)}
    urn = lambda kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page_id} {uri}')}>"
    request = _record("request", {"WARC-Record-ID": urn("request"), **common, "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n")
    if html is None:
        return [request, _record("response", {"WARC-Record-ID": urn("response"), **common, "X-No-Body": "1", "Content-Type": "application/octet-stream"}, b"")]
    body = html.encode()
    message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    return [request, _record("response", {"WARC-Record-ID": urn("response"), **common, "Content-Type": "application/http; msgtype=response"}, message)]


def write_pages(pages: DataFrame, path: str, level: int = 3) -> list[str]:
    """Write pages as ``.warc.gz`` files under ``path``, one for each partition; the files of the attempts that succeeded.

    A file has the name of its attempt, so a task that runs twice leaves a
    file that is in nobody's list.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
        fs, at = open_fs(name)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(at, compression=None) as out:

            def put(record: bytes) -> None:
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(member.compress(record) + member.flush())

            put(_record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.0\r\n"))
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    for record in page_records(*row):
                        put(record)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    chosen = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return sorted(r["file"] for r in chosen.mapInArrow(write, "file string").collect())  # a row for each partition


def pages_from(records: DataFrame) -> DataFrame:
    """Rows (page_id, url, html) of the responses among WARC records.

    Nulls come back as nulls, empty pages as empty; repeated pages come back
    as often as they were written. A url keeps all but raw line breaks, which
    are percent-encoded. Columns beside page_id, url and html are not archived.
    """
    responses = records.filter("warc_type = 'response'")
    body = F.when(F.element_at("headers", F.lit("x-no-body")).isNull(), F.col("payload").cast("string"))
    return responses.select(F.element_at("headers", F.lit("x-page-id")).cast("bigint").alias("page_id"), F.col("target_uri").alias("url"), body.alias("html"))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    files = write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return pages_from(read_warc(spark, ",".join(files), where={"warc_type": "response"}))


OP2_SQL = "SELECT page_id, url, html FROM pages"
