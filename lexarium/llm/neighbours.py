"""Operator 3: the nearest neighbours of vectors.

Vantage-point trees per shard. Vectors go to the shard of their nearest pivot
(one for every ``SHARD_ROWS`` vectors, drawn by hash, ``MAX_PIVOTS`` at most, so
that placing a vector costs the same at any size); a shard is the cell of its
pivot and lies in a ball around it. A shard of more than twice ``SHARD_ROWS``
vectors, as many equal vectors make one, is dealt to several parts by hash;
each part has a vantage-point tree. Every query first searches its own part;
the distance of its k-th neighbour there then tells by the triangle inequality
which other cells and balls can hold a nearer one, and it visits only those.
In a tree the same inequality prunes the sides of every node. Both tests divide
the k-th distance by ``factor``: at 1 the search is exact, above it prunes more
and may miss some.

Queries run through a tree in batches, so that all distances are matrix
operations. A part is copied to as many tasks as its visitors need, at most
``QUERY_ROWS`` each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from .store import stash

K_NEAREST = 10
FACTOR = 1.0
SHARD_ROWS = 4096
MAX_PIVOTS = 1024
QUERY_ROWS = 65_536
#: The registered query searches for every vector whose id is divisible by this.
QUERY_EVERY = 20
LEAF = 64
PLACES = 6
SLACK = 10.0**-PLACES

_FOUND = "vec_id bigint, neighbour_id bigint, distance double"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0)).round(PLACES)


class Tree:
    """A vantage-point tree over the rows of a matrix, by Euclidean distance."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.ids, self.rows, self.leaf = ids, rows, leaf
        self.root = self._build(np.arange(len(ids)))

    def _build(self, own: np.ndarray):
        if len(own) <= self.leaf:
            return own
        # of a few rows the one whose distances to the others spread most
        tried = own[:: max(1, len(own) // 5)][:5]
        spread = _distances(self.rows[tried], self.rows[own[:: max(1, len(own) // 256)]]).std(1)
        vantage = tried[int(spread.argmax())]
        own = own[own != vantage]
        d = _distances(self.rows[vantage : vantage + 1], self.rows[own])[0]
        middle = float(np.median(d))
        near = d <= middle
        if near.all():
            return np.append(own, vantage)  # rows at one distance cannot be parted
        bounds = [(float(d[s].min()), float(d[s].max())) for s in (near, ~near)]
        return vantage, bounds, self._build(own[near]), self._build(own[~near])

    def search(self, queries: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(neighbour ids, distances), k each, of rows within ``bound``, equal distances by id; empty places have id -1. A query is not its own neighbour."""
        best = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), -1, np.int64)

        def offer(q: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
            d = np.where(self.ids[rows][None, :] == ids[q][:, None], np.inf, d)
            nearer = np.flatnonzero(d.min(1) <= best[q].max(1))
            q, d = q[nearer], d[nearer]
            if not len(q):
                return
            every = np.concatenate([best[q], d], 1)
            names = np.concatenate([who[q], np.broadcast_to(self.ids[rows], d.shape)], 1)
            keep = np.lexsort((names, every))[:, :k]
            best[q], who[q] = np.take_along_axis(every, keep, 1), np.take_along_axis(names, keep, 1)

        home = np.full(len(queries), -1)

        def gaps(vantage: int, bounds, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
            d = _distances(queries[q], self.rows[vantage : vantage + 1])
            return d, [np.maximum(np.maximum(low - d[:, 0], d[:, 0] - high), 0) for low, high in bounds]

        def descend(node, q: np.ndarray) -> None:
            """Every query looks into the leaf on its side of all nodes: that gives it a first reach."""
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                home[q] = id(node)
                offer(q, node, _distances(queries[q], self.rows[node]))
                return
            vantage, bounds, *sides = node
            _, gap = gaps(vantage, bounds, q)
            inner = gap[0] <= gap[1]
            descend(sides[0], q[inner])
            descend(sides[1], q[~inner])

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                q = q[home[q] != id(node)]
                if len(q):
                    offer(q, node, _distances(queries[q], self.rows[node]))
                return
            vantage, bounds, *sides = node
            d, gap = gaps(vantage, bounds, q)
            offer(q, np.array([vantage]), d)
            for side in (0, 1):
                visit(sides[side], q[gap[side] <= (np.minimum(best[q].max(1), bound[q]) + 2 * SLACK) / factor])

        descend(self.root, np.arange(len(queries)))
        visit(self.root, np.arange(len(queries)))
        who = np.where(np.isfinite(best), who, -1)
        return who, best


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _found(ids: np.ndarray, who: np.ndarray, best: np.ndarray) -> list[np.ndarray]:
    ok = (who >= 0).ravel() | (np.isfinite(best)).ravel()
    return [np.repeat(ids, who.shape[1])[ok], who.ravel()[ok], best.ravel()[ok]]


def nearest(vectors: DataFrame, k: int = K_NEAREST, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, every: int = 1, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """Rows (vec_id, neighbour_id, distance, rank): the ``k`` nearest other vectors, by Euclidean distance, of each whose id ``every`` divides.

    Equal distances (to 6 digits) go by neighbour_id. Vectors are of the
    dimension that most rows have (of equally many the lesser); rows of
    another one, and such with a null id, a null vector, or nulls or values
    that are not finite in it, are left out. Of rows that repeat an id the one
    with the least vector counts. Smaller tables give fewer neighbours, other
    columns are ignored, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    plain = plain.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    size = plain.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], _FOUND + ", rank int")
    clean = plain.filter(F.size("v") == size["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    wanted = min(max_pivots, -(-size["count"] // shard_rows))
    pivots = np.array([r["v"] for r in clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()])  # max_pivots rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("v")), pivots)
                yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1)), pa.array(d.min(1)), *batch.columns], names=["shard", "far", "vec_id", "v"])

    placed = stash(clean.mapInArrow(assign, "shard bigint, far double, vec_id bigint, v array<double>"), "ann-shards")
    radius, count = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("shard").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # max_pivots rows at most
        radius[r["shard"]], count[r["shard"]] = r["far"], r["n"]
    splits = np.maximum(1, -(-count // (2 * shard_rows)))

    def dealt(shard: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (K.mix(ids.view(np.uint64)) % splits[shard].astype(np.uint64)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, ids = np.asarray(batch.column("shard"), np.int64), np.asarray(batch.column("vec_id"), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(dealt(shard, ids)), batch.column("vec_id"), batch.column("v")], names=["shard", "part", "vec_id", "v"])

    parts = placed.select("shard", "vec_id", "v").mapInArrow(deal, "shard bigint, part bigint, vec_id bigint, v array<double>")

    def own(table: pa.Table) -> pa.Table:
        ids, rows = np.asarray(table.column("vec_id")), _matrix(table.column("v"))
        asked = ids % every == 0
        who, best = Tree(ids, rows).search(rows[asked], ids[asked], k, np.full(int(asked.sum()), np.inf), factor)
        kept = table.filter(pa.array(asked))
        return pa.table({**{c: kept.column(c) for c in ("vec_id", "v", "shard", "part")}, "reach": pa.array(best.max(1)), "who": pa.array(who.tolist(), pa.list_(pa.int64())), "best": pa.array(best.tolist(), pa.list_(pa.float64()))})

    first = stash(parts.groupBy("shard", "part").applyInArrow(own, "vec_id bigint, v array<double>, shard bigint, part bigint, reach double, who array<bigint>, best array<double>"), "ann-own")

    def visits(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of all visits; a query also visits its own shard if that has other parts."""
        d = _distances(_matrix(batch.column("v")), pivots)
        reach, mine = np.asarray(batch.column("reach")), np.asarray(batch.column("shard"))
        d = np.maximum(d - radius, (d - d[np.arange(len(d)), mine][:, None]) / 2)
        return np.nonzero((d <= (reach[:, None] + 4 * SLACK) / factor) & ((np.arange(len(pivots)) != mine[:, None]) | (splits > 1)) & np.isfinite(radius))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(visits(batch)[1], minlength=len(pivots))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(total)], names=["shard", "n"])

    asking = first.select("shard", "part", "vec_id", "v", "reach")
    visitors = np.zeros(len(pivots), np.int64)
    for r in asking.mapInArrow(tally, "shard bigint, n bigint").groupBy("shard").agg(F.sum("n").alias("n")).collect():  # max_pivots rows at most
        visitors[r["shard"]] = r["n"]
    copies = np.maximum(1, -(-visitors // query_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, s = visits(batch)
            ids, mine, home = (np.asarray(batch.column(c)) for c in ("vec_id", "shard", "part"))
            times = splits[s]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            q, s = np.repeat(q, times), np.repeat(s, times)
            other = (s != mine[q]) | (part != home[q])
            q, s, part = q[other], s[other], part[other]
            copy = (K.mix(ids.view(np.uint64), 3)[q] % copies[s].astype(np.uint64)).astype(np.int64)
            for at in range(0, len(q), 5_000):
                cut = slice(at, at + 5_000)
                rows = batch.take(pa.array(q[cut]))
                yield pa.RecordBatch.from_arrays([pa.array(s[cut]), pa.array(part[cut]), pa.array(copy[cut]), *(rows.column(c) for c in ("vec_id", "v", "reach"))], names=["shard", "part", "copy", "vec_id", "v", "reach"])

    def others(shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not shard.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["vec_id", "neighbour_id", "distance"])
        ids = np.asarray(queries.column("vec_id"))
        tree = Tree(np.asarray(shard.column("vec_id")), _matrix(shard.column("v")))
        return pa.table(_found(ids, *tree.search(_matrix(queries.column("v")), ids, k, np.asarray(queries.column("reach")), factor)), ["vec_id", "neighbour_id", "distance"])

    routed = asking.mapInArrow(route, "shard bigint, part bigint, copy bigint, vec_id bigint, v array<double>, reach double")
    needed = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(copies) if visitors[i]], "shard bigint, copies bigint"))  # max_pivots rows at most
    spread = parts.join(needed, "shard").select("shard", "part", F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"), "vec_id", "v")
    visited = spread.groupBy("shard", "part", "copy").cogroup(routed.groupBy("shard", "part", "copy")).applyInArrow(others, _FOUND)
    home = first.select("vec_id", F.explode(F.arrays_zip("who", "best")).alias("x")).select("vec_id", F.col("x.who").alias("neighbour_id"), F.col("x.best").alias("distance")).filter("neighbour_id <> -1 or distance < double('infinity')")
    every_one = home.union(visited)
    return every_one.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy("distance", "neighbour_id"))).filter(F.col("rank") <= k)


def op3_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=QUERY_EVERY)


OP3_SQL = """
WITH e AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 GROUP BY vec_id
), d AS (
  SELECT q.vec_id, b.vec_id AS neighbour_id, round(list_distance(q.v, b.v), 6) AS distance FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM d) WHERE rank <= 10
"""
