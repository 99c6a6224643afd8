"""One object for a lexicon: its tables, and the operators on them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.errors import IndexMissing
from lexarium.operators import index as fts
from lexarium.operators import lookup, search
from lexarium.sources import lexicon_source, sinks


class Lexicon:
    """Entries and, once built or loaded, a full-text index."""

    def __init__(self, entries: DataFrame, index: fts.FtsIndex | None = None, path: str | None = None):
        self.entries, self.index, self.path = entries, index, path

    @classmethod
    def open(cls, spark: SparkSession, *paths: str, **options) -> Lexicon:
        return cls(lexicon_source.load(spark, *paths, **options))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Lexicon:
        """One saved by :meth:`save`."""
        try:
            index = fts.load(spark, f"{path}/index")
        except IndexMissing:
            index = None
        return cls(spark.read.parquet(f"{path}/entries"), index, path)

    def reload(self) -> Lexicon:
        """The same saved lexicon as it now is on disk; nothing that was read before is kept."""
        if self.path is None:
            raise IndexMissing("the lexicon is not saved")
        self.clear_cache()
        return Lexicon.load(self.entries.sparkSession, self.path)

    def clear_cache(self) -> None:
        """Let go of cached tables and of what is known about the files."""
        for table in [self.entries, *([self.index.docs, self.index.postings, self.index.terms] if self.index else [])]:
            table.unpersist()
        if self.path is not None:
            self.entries.sparkSession.catalog.refreshByPath(self.path)

    @property
    def built(self) -> bool:
        """Whether both the entries by key and the full-text index are there."""
        return self.index is not None and self.index.built and not self.entries.isEmpty()

    def clear_index(self) -> Lexicon:
        return Lexicon(self.entries, None, self.path)

    def verify(self) -> DataFrame:
        """Rows (problem, n) over keys and index; all n are 0 where nothing is wrong."""
        found = search.integrity(self.entries).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
        return found if self.index is None else found.union(fts.validate(self.index))

    def save(self, path: str, with_index: bool = True) -> Lexicon:
        sinks.save_lexicon(self.entries, path, with_index)
        return Lexicon.load(self.entries.sparkSession, path)

    def build_index(self, path: str | None = None, **settings) -> Lexicon:
        """With an index: kept at ``path`` where one is given, else computed anew by every query."""
        index = fts.build(self.entries, **settings)
        return Lexicon(self.entries, fts.save(index, path) if path else index)

    def _index(self) -> fts.FtsIndex:
        if self.index is None:
            raise IndexMissing("build or load an index first")
        return self.index

    def get(self, key: str) -> DataFrame:
        return lookup.get(self.entries, key)

    def contains(self, keys: DataFrame) -> DataFrame:
        return lookup.contains(self.entries, keys)

    def get_many(self, keys: DataFrame | Iterable[str]) -> DataFrame:
        return lookup.get_many(self.entries, keys if isinstance(keys, DataFrame) else lookup.key_positions(self.entries.sparkSession, keys))

    def prefix(self, start: str, limit: int | None = lookup.PREFIX_LIMIT) -> DataFrame:
        return lookup.prefix(self.entries, start, limit)

    def key_range(self, low: str, high: str) -> DataFrame:
        return lookup.key_range(self.entries, low, high)

    def ordinal_range(self, start: int, end: int) -> DataFrame:
        return lookup.ordinal_range(self.entries, start, end)

    def fuzzy(self, word: str, most: int = 2) -> DataFrame:
        return search.fuzzy(self.entries, word, most)

    def fulltext(self, query: str, limit: int | None = None) -> DataFrame:
        return search.fulltext_entries(self._index(), self.entries, query, limit)

    def suggest(self, word: str) -> DataFrame:
        return search.suggest(self._index(), word)

    def statistics(self) -> DataFrame:
        return fts.statistics(self._index())

    def search(self, query: str, kind: search.Kind, limit: int | None = None) -> DataFrame:
        return search.search_multiple(self.entries, query, kind, self.index, limit)

    def integrity(self) -> DataFrame:
        return search.integrity(self.entries)

    @staticmethod
    def merge(parts: Sequence[Lexicon], name: str | None = None, path: str | None = None) -> Lexicon:
        """One lexicon of all; with ``path`` its entries and its index are written there in one go."""
        merged = Lexicon(search.merge([p.entries for p in parts], name).drop("source_dict"))
        return merged if path is None else merged.save(path)
