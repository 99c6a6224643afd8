"""``python -m lexarium.cli info|search|validate PATH...``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexarium.functions.text import sanitize
from lexarium.lexicon import Lexicon
from lexarium.operators.search import Kind
from lexarium.sources import lexicon_source


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> list[tuple]:
    parser = argparse.ArgumentParser(prog="lexarium")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("info", "validate"):
        sub.add_parser(name).add_argument("paths", nargs="+")
    find = sub.add_parser("search")
    find.add_argument("query")
    find.add_argument("paths", nargs="+")
    find.add_argument("--kind", choices=[k.value for k in Kind], default="prefix")
    find.add_argument("--limit", type=int, default=10)
    options = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("lexarium").getOrCreate()
    if options.command == "info":
        table = lexicon_source.metadata(spark, *options.paths).select("dict_id", "name", "format", "entries", "language")
    elif options.command == "validate":
        table = lexicon_source.validate(spark, *options.paths)
    else:
        found = Lexicon.open(spark, *options.paths).search(options.query, Kind(options.kind), options.limit)
        table = found.limit(options.limit).select("source_dict", sanitize("key").alias("key"), "score")
    rows = [tuple(r) for r in table.collect()]
    for row in rows:
        print(*("" if x is None else x for x in row), sep="\t")
    return rows


if __name__ == "__main__":
    main()
