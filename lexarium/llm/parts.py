"""Answers for scan partitions: what a shuffle finds out about texts goes back to the task that scans them.

A plain scan of files has the same partitions each time, so a task can report
on its texts under the number of its partition, and the task of that number in
a second scan reads the answers. No text is shuffled. Tables of answers lie in
as many folders as the session has shuffle partitions, whatever the number of
scan partitions. A scan that finds other texts under its number than were
reported (files split anew between two scans) raises :class:`Moved`;
:func:`settled` then starts over.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_path, stash
from .warc import open_fs

_MOVED = "the scan has other partitions than the one before"


class Moved(RuntimeError):
    def __init__(self) -> None:
        super().__init__(_MOVED)


def settled(make: Callable[[], DataFrame], tries: int = 4) -> DataFrame:
    """What ``make`` returns (it must run its jobs itself), from the start again where partitions have moved."""
    for left in range(tries - 1, -1, -1):
        try:
            return make()
        except Exception as e:  # noqa: BLE001 - an error of a task comes as one of several classes
            if _MOVED not in str(e) or not left:
                raise
    raise AssertionError


def as_scan(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it only selects from files, else a written copy of it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = re.findall(r"^[\s:+\-!]*([A-Za-z]+)", plan, re.MULTILINE)
    plain = set(nodes) <= {"Project", "Filter", "Relation"} and nodes.count("Relation") == 1
    return df if plain else stash(df, name)


def put(answers: DataFrame, name: str, kind: pa.DataType = pa.int32()) -> tuple[str, int, pa.DataType]:
    """Write rows with a column ``part`` of that kind, in its order; returns what :func:`get` needs."""
    spark = answers.sparkSession
    path, folders = new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = answers.withColumn("folder", F.expr(f"cast(pmod(part, {folders}) as int)"))
    sorted_ = placed.repartitionById(folders, F.col("folder")).sortWithinPartitions("folder", "part")  # a task for each folder
    sorted_.write.option("compression", "zstd").partitionBy("folder").parquet(path)
    return path, folders, kind


def get(where: tuple[str, int, pa.DataType], part: int, schema: pa.Schema) -> pa.Table:
    """The rows of one part."""
    path, folders, kind = where
    fs, at = open_fs(path)
    at = f"{at}/folder={part % folders}"
    if not fs.get_file_info(at).type.value:
        return schema.empty_table()
    files = pads.dataset(at, filesystem=fs, format="parquet", schema=pa.schema([pa.field("part", kind), *schema]))
    return files.to_table(columns=schema.names, filter=pc.field("part") == part)
