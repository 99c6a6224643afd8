"""``spark.read.format("lexicon")``: dictionaries of all formats as one table.

A dictionary is shared out by ordinal (by record block for MDict) to as many
tasks as its bytes ask for, or as the option ``partitions`` tells; a task of a
StarDict or BGL dictionary reads its own stretch of the index alone, one of DSL
its own stretch of a file that begins with a byte-order mark; any other DSL or
MDict task decodes the headwords of the whole file. The options ``key``, ``keyPrefix`` and ``dictId`` keep only
such entries: keys are tested before an entry becomes a row, dictionaries before
a file is opened. (They are options since Spark 4.1 keeps the filters it pushed
into a Python source with the relation, so that a second query over the same
DataFrame would see those of the first.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexarium.errors import InvalidFormat, NotFound
from lexarium.functions.encoding import convert, detect
from lexarium.model import LEXICON, METADATA

from . import files
from .formats import FORMATS, Window, detect_format, dsl_tags, is_valid, open_dictionary, scan_directory

_SCHEMA = pa.schema([("dict_id", pa.string()), ("ord", pa.int64()), ("key", pa.string()), ("entry", pa.binary()), ("text", pa.string())])
_TAGS = pa.struct([("plain", pa.string()), ("has_media", pa.bool_()), ("has_transcription", pa.bool_()), ("margin_tags", pa.list_(pa.string()))])
_BATCH_ROWS, _BATCH_BYTES = 4096, 8 << 20
#: A dictionary of less is one task, which alone opens it; a larger one has a task for every so many bytes.
TASK_BYTES = 16 << 20


_ALL = 1 << 62


@dataclass
class Slice(InputPartition):
    path: str
    format: str
    dict_id: str
    start: int
    end: int
    window: Window | None = None


def dictionary_id(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        return convert(raw, detect(raw))
    except InvalidFormat:
        return raw.decode("utf-8", "replace")


class LexiconReader(DataSourceReader):
    def __init__(self, options: dict[str, str], format_: str | None):
        self.paths = [p for p in options["path"].split(",") if p]
        self.format = options.get("dictionaryformat", format_)
        self.tasks = int(options.get("partitions", 0))
        self.strict = options.get("strict", "true").lower() == "true"
        self.key, self.start, self.dict_id = options.get("key"), options.get("keyprefix", ""), options.get("dictid")

    def partitions(self) -> list[Slice]:
        out: list[Slice] = []
        for path in self.paths:
            fs, at = files.locate(path)
            info = fs.get_file_info(at)
            if info.is_file:
                found = [(path, self.format or detect_format(path))]
            elif info.type.value == 0:
                raise NotFound(path)
            else:
                found = [(p, f) for p, f in scan_directory(path) if self.format in (None, f)]
            for name, kind in found:
                if self.dict_id not in (None, dictionary_id(name)):
                    continue
                tasks = self.tasks or -(-files.size(name) // TASK_BYTES)
                if kind == "stardict" and not self.tasks:
                    tasks = -(-sum(files.size(f) for f in files.beside(name)) // TASK_BYTES)
                if tasks <= 1:
                    out.append(Slice(name, kind, dictionary_id(name), 0, _ALL))
                    continue
                dictionary = open_dictionary(name, kind, self.strict)
                if hasattr(dictionary, "stretches") and not self.tasks and (cuts := dictionary.stretches(TASK_BYTES)):
                    out += [Slice(name, kind, dictionary_id(name), w.start, w.end, w) for w in cuts]
                    continue
                rows = dictionary.rows()
                step = max(1, -(-rows // tasks))
                cuts = dictionary.cuts(step) if hasattr(dictionary, "cuts") else [Window(s, s + step) for s in range(0, rows, step)]
                out += [Slice(name, kind, dictionary_id(name), w.start, w.end, w) for w in cuts]
        return out or [Slice("", "", "", 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, weight = [], 0
        for at, key, entry in open_dictionary(partition.path, partition.format, self.strict, partition.window).entries(partition.start, partition.end):
            if self.key not in (None, key) or not key.startswith(self.start):
                continue
            rows.append({"dict_id": partition.dict_id, "ord": at, "key": key, "entry": entry, "text": _text(entry)})
            weight += len(entry) * 2 + 64
            if len(rows) >= _BATCH_ROWS or weight >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                rows, weight = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


class LexiconSource(DataSource):
    """Files of any known format, told by extension or first bytes."""

    FORMAT: str | None = None

    @classmethod
    def name(cls) -> str:
        return cls.FORMAT or "lexicon"

    def schema(self) -> str:
        return LEXICON

    def reader(self, schema) -> LexiconReader:
        return LexiconReader({k.lower(): v for k, v in self.options.items()}, self.FORMAT)


class StarDictSource(LexiconSource):
    FORMAT = "stardict"


class DslSource(LexiconSource):
    FORMAT = "dsl"


class ZimSource(LexiconSource):
    FORMAT = "zim"


class MDictSource(LexiconSource):
    FORMAT = "mdict"


class BglSource(LexiconSource):
    FORMAT = "bgl"


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    for source in (LexiconSource, StarDictSource, DslSource, ZimSource, MDictSource, BglSource):
        spark.dataSource.register(source)


def load(spark: SparkSession, *paths: str, format: str | None = None, **options) -> DataFrame:
    """Dictionaries as one lexicon; the first that cannot be read fails all."""
    register(spark)
    return spark.read.format(format or "lexicon").options(**options).load(",".join(paths))


def metadata(spark: SparkSession, *paths: str, format: str | None = None) -> DataFrame:
    rows = []
    for path in paths:
        kind = format or detect_format(path)
        rows.append({"dict_id": dictionary_id(path), "format": kind} | open_dictionary(path, kind).metadata())
    columns = [c.split(" ")[0] for c in METADATA.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], METADATA)


def dsl_cards(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows (dict_id, key, body, plain, has_media, has_transcription, margin_tags) of the cards of DSL files: what their tags tell."""
    cards = load(spark, *paths, format="dsl").select("dict_id", "key", F.col("text").alias("body"))

    def tags(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else dsl_tags(x) for x in column.to_pylist()], _TAGS)

    told = F.arrow_udf(tags, "struct<plain:string,has_media:boolean,has_transcription:boolean,margin_tags:array<string>>")
    return cards.withColumn("x", told("body")).select("dict_id", "key", "body", "x.*")


def supported_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f,) for f in FORMATS], "format string")


def validate(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows (path, format, valid), each file looked at in its own task."""

    def look(column: pa.Array) -> pa.Array:
        out = []
        for path in column.to_pylist():
            valid = is_valid(path)
            out.append({"format": detect_format(path) if valid else None, "valid": valid})
        return pa.array(out, pa.struct([("format", pa.string()), ("valid", pa.bool_())]))

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return table.withColumn("x", F.arrow_udf(look, "struct<format:string,valid:boolean>")("path")).select("path", "x.format", "x.valid")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, format) of the dictionaries in a folder."""
    return spark.createDataFrame(scan_directory(folder), "path string, format string")


def stardict_fields(text: bytes, sequence: str) -> list[tuple[str, bytes]]:
    """(type, bytes) of the fields of an entry by a ``sametypesequence``: lower-case types end with NUL, upper-case ones have a length; the last has the rest."""
    out, at = [], 0
    for i, kind in enumerate(sequence):
        last = i == len(sequence) - 1
        if kind.isupper():
            if last:
                end = stop = len(text)
            else:
                size = int.from_bytes(text[at : at + 4], "big")
                at += 4
                end = stop = at + size
        else:
            end = len(text) if last else text.find(b"\0", at)
            if end < 0:
                raise InvalidFormat("a field without end")
            stop = end if last else end + 1
        if end > len(text):
            raise InvalidFormat("a field beyond its entry")
        out.append((kind, text[at:end]))
        at = stop
    return out
