"""Approximate nearest neighbours by low-dimensional stable projections indexed by kd-trees.

Unit vectors are projected on ``SIZE`` Gaussian directions. For a pair at distance d, the squared projected distance over d squared has
a chi-square distribution with ``SIZE`` degrees of freedom. A search looks at a kd-tree of projected points, nearest cells
first, and verifies with the original vectors; it stops when the next cell is so far that a vector still nearer than the
k-th one found would have to have a projected distance beyond the chi-square quantile ``CHANCE``. So each true neighbour is found
with at least about that chance.

The upper levels of the kd-tree, fit on a bounded sample, deal the vectors out over Spark partitions. A query searches its own
cell first; with the distance found there, the same test rules out other cells, and the rest are searched.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrylog.llm.vectors import matrix, sizes_of, unit, usable
from ferrylog.session import materialise

SIZE, CHANCE = 8, 0.98
SAMPLE = 20_000
#: Vectors per partition cell, queries searched together, and points per leaf.
CELL, QUERIES_AT_ONCE, LEAF = 8192, 4096, 256


def chi_square_quantile(chance: float, freedom: int) -> float:
    """For an even number of degrees of freedom, whose tail is a finite sum."""
    if freedom % 2:
        raise ValueError("degrees of freedom must be even")
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
    low, high = 0.0, 10.0 * freedom + 100.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(middle) > 1 - chance else (low, middle)
    return high


class Cells:
    """The upper levels of a kd-tree: splits of the projected space at medians of a sample, and the cells' boxes."""

    def __init__(self, sample: np.ndarray, count: int):
        size = sample.shape[1]
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, left, right; a negative child is a cell
        self.low, self.high = [], []

        def grow(points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
            axis = int(np.ptp(points, axis=0).argmax()) if len(points) > 1 else 0
            left_cells = cells // 2
            value = float(np.quantile(points[:, axis], left_cells / cells)) if cells > 1 and len(points) > 1 else 0.0
            if cells <= 1 or len(points) < 2 or not (points[:, axis] > value).any() or not (points[:, axis] <= value).any():
                self.low.append(low)
                self.high.append(high)
                return -len(self.low)
            own = len(self.splits)
            self.splits.append((axis, value, 0, 0))
            is_left = points[:, axis] <= value
            left_high, right_low = high.copy(), low.copy()
            left_high[axis] = right_low[axis] = value
            children = grow(points[is_left], left_cells, low, left_high), grow(points[~is_left], cells - left_cells, right_low, high)
            self.splits[own] = (axis, value, *children)
            return own

        self.root = grow(sample, count, np.full(size, -np.inf), np.full(size, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            axis, value, left, right = self.splits[node]
            is_left = points[rows, axis] <= value
            todo += [(left, rows[is_left]), (right, rows[~is_left])]
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell's box."""
        out = np.zeros((len(points), len(self.low)))
        for axis in range(points.shape[1]):
            p = points[:, axis][:, None]
            out += np.maximum(np.maximum(self.low[:, axis][None, :] - p, p - self.high[:, axis][None, :]), 0.0) ** 2
        return out


class Tree:
    """A kd-tree over projected points: rows in the order of leaves, each leaf with its bounding box."""

    def __init__(self, projected: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(projected))
        bounds: list[tuple[int, int]] = []
        todo = [(0, len(projected))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                if b > a:
                    bounds.append((a, b))
                continue
            rows = self.order[a:b]
            axis = int(np.ptp(projected[rows], axis=0).argmax())
            middle = (b - a) // 2
            self.order[a:b] = rows[np.argpartition(projected[rows, axis], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        self.bounds = sorted(bounds)
        own = projected[self.order]
        self.low = np.array([own[a:b].min(axis=0) for a, b in self.bounds])
        self.high = np.array([own[a:b].max(axis=0) for a, b in self.bounds])


def search(tree: Tree, projected: np.ndarray, vectors: np.ndarray, ids: np.ndarray, query: tuple[int, np.ndarray, np.ndarray, float], k: int, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest found (ids and cosines), nearest first, ties to smaller ids.

    ``projected``, ``vectors`` (unit) and ``ids`` are in the tree's order; ``query`` is its id, projection, unit vector and the cosine of the
    k-th neighbour already known elsewhere (-inf: none).
    """
    own, point, vector, known = query
    gaps = np.maximum(np.maximum(tree.low - point, point - tree.high), 0.0)
    far = (gaps * gaps).sum(axis=1)
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    limit = (2 - 2 * known) * quantile if known > -np.inf else np.inf
    for leaf in np.argsort(far, kind="stable"):
        if far[leaf] > limit:
            break
        a, b = tree.bounds[leaf]
        steps = projected[a:b] - point
        near = np.flatnonzero((steps * steps).sum(axis=1) <= limit) + a
        near = near[ids[near] != own]
        if not len(near):
            continue
        cosines = vectors[near] @ vector
        best_ids, best = np.concatenate([best_ids, ids[near]]), np.concatenate([best, cosines])
        if len(best) > k:
            least = np.partition(best, len(best) - k)[len(best) - k]
            some = best >= least
            best_ids, best = best_ids[some], best[some]
            order = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[order], best[order]
        if len(best) == k:
            limit = min(limit, (2 - 2 * max(best.min(), known)) * quantile + 1e-12)
    order = np.lexsort((best_ids, -best))
    return best_ids[order], best[order]


def _searched(points: DataFrame, asked: DataFrame, k: int, quantile: float) -> DataFrame:
    """``query_id, vec_id, score``: of each query in ``asked`` (``shard, block, query_id, vector, projected, known``) the nearest in that shard.

    A shard is sent to each block of queries that asks for it, and searched by a tree built there.
    """
    asked = asked.toDF(*asked.columns)  # columns of its own: both sides come from one table
    places = asked.select("shard", "block").distinct().toDF("shard", "block")
    held = points.join(places, "shard").select("shard", "block", "vec_id", "vector", "projected")

    def run(keys, own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = {"query_id": [], "vec_id": [], "score": []}
        if len(own) and len(queries):
            own, queries = own.sort_values("vec_id"), queries.sort_values("query_id")
            projected = np.stack(own["projected"].to_list())
            tree = Tree(projected)
            projected, vectors, ids = projected[tree.order], np.stack(own["vector"].to_list())[tree.order], own["vec_id"].to_numpy()[tree.order]
            for query in zip(queries["query_id"], queries["projected"], queries["vector"], queries["known"], strict=True):
                found, cosines = search(tree, projected, vectors, ids, query, k, quantile)
                columns["query_id"] += [query[0]] * len(found)
                columns["vec_id"] += found.tolist()
                columns["score"] += cosines.tolist()
        return pd.DataFrame(columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, chance: float = CHANCE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by cosine, found among all rows but those of the query's own id.

    ``is_query`` is a condition on ``rows``. Nearest first, ties to the smaller id; fewer if there are fewer candidates.
    Rows without an id and vectors that are null, empty, zero, or hold null or non-finite components take no part, also not as queries;
    the others are compared with those of as many components, each length having an index of its own. Rows that repeat an id and its vector are one. Of equal vectors only the ``k + 1`` smallest
    ids can be among the nearest, so only these are indexed. An empty table gives none. Other columns are not looked at.
    """
    chosen = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    chosen = chosen.where(F.col("vec_id").isNotNull() & usable("vector"))
    found = [_nearest_of(chosen.where(F.size("vector") == width), width, k, size, chance) for width in sizes_of(chosen, "vector")]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(found) > 1:  # an id may stand for vectors of several lengths
        found = [_top(functools.reduce(DataFrame.union, found).drop("rank"), k)]
    return found[0].select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _nearest_of(chosen: DataFrame, width: int, k: int, size: int, chance: float) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``vec_id, vector, asks`` with vectors of ``width`` components."""
    spark = chosen.sparkSession
    chosen = chosen.groupBy("vec_id", "vector").agg(F.max("asks").alias("asks"))
    copies = Window.partitionBy("vector").orderBy("vec_id")
    # each task keeps its first k + 1 of a vector before the shuffle
    few = chosen.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    directions = np.random.default_rng(97).normal(size=(max(width, 1), size))

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lists = pa.list_(pa.float64())
        for batch in batches:
            own = unit(matrix(batch.column("vector"), width))
            as_lists = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), as_lists(own), as_lists(own @ directions), batch.column("asks"), batch.column("indexed")],
                schema=pa.schema([("vec_id", pa.int64()), ("vector", lists), ("projected", lists), ("asks", pa.bool_()), ("indexed", pa.bool_())]),
            )

    flat = few.select("vec_id", "vector", F.lit(False).alias("asks"), F.lit(True).alias("indexed"))
    flat = flat.unionByName(chosen.where("asks").select("vec_id", "vector", "asks", F.lit(False).alias("indexed")))
    points = materialise(flat.mapInArrow(project, "vec_id long, vector array<double>, projected array<double>, asks boolean, indexed boolean"), "projected")
    count = points.where("indexed").count()
    sample = points.where("indexed").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("projected").collect()
    cells = spark.sparkContext.broadcast(Cells(np.array([r["projected"] for r in sample]), max(1, math.ceil(count / CELL))))

    @F.pandas_udf("int")
    def cell_of(projected: pd.Series) -> pd.Series:
        return pd.Series(cells.value.of(np.stack(projected.to_list())) if len(projected) else [], dtype="int32")

    @F.pandas_udf("array<int>")
    def cells_within(projected: pd.Series, limit: pd.Series) -> pd.Series:
        if not len(projected):
            return pd.Series([], dtype=object)
        near = cells.value.distances(np.stack(projected.to_list())) <= limit.to_numpy()[:, None]
        return pd.Series([np.flatnonzero(r).astype(np.int32) for r in near])

    placed = materialise(points.withColumn("cell", cell_of("projected")), "cells")
    # a cell that holds far more than was meant is cut by a hash of the id
    cuts = materialise(placed.where("indexed").groupBy("cell").count().select("cell", F.ceil(F.col("count") / (2 * CELL)).cast("int").alias("cuts")), "cuts")
    shard = F.struct("cell", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).alias("cut"))
    held = placed.where("indexed").join(cuts, "cell").select(shard.alias("shard"), "vec_id", "vector", "projected")
    queries = placed.where("asks").select(F.col("vec_id").alias("query_id"), "vector", "projected", "cell")
    blocks = max(1, math.ceil(queries.count() / QUERIES_AT_ONCE))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    quantile = chi_square_quantile(chance, size)

    def to_shards(asked: DataFrame) -> DataFrame:
        each = asked.join(cuts, "cell").withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts").cast("long") - 1)))
        return each.select(F.struct("cell", "cut").alias("shard"), "block", "query_id", "vector", "projected", "known")

    never = F.lit(float("-inf"))
    first = materialise(_top(_searched(held, to_shards(queries.withColumn("known", never)), k, quantile), k), "first")
    known = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(never).alias("known"))
    again = queries.withColumnRenamed("cell", "own").join(known, "query_id", "left").withColumn("known", F.coalesce("known", never))
    limit = F.when(F.col("known") == never, float("inf")).otherwise((2 - 2 * F.col("known")) * quantile + 1e-12)
    again = again.withColumn("cell", F.explode(cells_within("projected", limit))).where("cell != own")
    found = _searched(held, to_shards(again), k, quantile).union(first.select("query_id", "vec_id", "score"))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
