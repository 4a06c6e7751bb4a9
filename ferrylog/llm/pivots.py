"""Near-duplicate vectors by a pivot-permutation index.

Pivots are reference points. A vector is described by the few pivots nearest to it. Inverted lists file it
under its pivots; vectors whose count of shared pivots is two or more are candidates, which is to say that they meet in the list of
some pair of pivots. Pivots grow with the square root of the number of vectors, so that a vector's candidates
grow with it too and not with the table; near vectors share fewer of many pivots, which a longer description makes up for (see ``described_by``). A pair that meets in several lists is looked at in the list of the two smallest pivots it shares, and
counts as a link if its cosine, in double precision, is large enough. Equal vectors are one class from the start.

Long lists are cut into blocks that meet pairwise. Links are not listed: a block yields numbers of links per vector
and a spanning forest.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylog.llm.common import arrow_table
from ferrylog.llm.graph import components
from ferrylog.llm.vectors import distinct_vectors, matrix, sizes_of, unit, usable
from ferrylog.operators.skew import lookup_join
from ferrylog.session import materialise

#: The least and greatest number of reference points, and the cosine that none is closer than to another.
PIVOTS, MOST_PIVOTS, APART = 256, 8192, 0.8
#: They come from so many hash-chosen vectors, or four times the pivots as long as their sample has no more components than this.
SAMPLE, SAMPLE_COMPONENTS = 4096, 1 << 22
#: Nearest pivots that describe a vector, of the least number.
PREFIX = 7
BLOCK = 1024


def described_by(vectors: int) -> tuple[int, int]:
    """How many pivots an index of so many vectors has, and how many describe a vector.

    With one more nearest pivot per doubling, random vectors of 64 components at a cosine of 0.9 share two pivots with a chance of
    0.99 at any size, and unrelated ones with 0.017 at 256 pivots, 0.0045 at 1,024 and 0.001 at 4,096 (measured): about 4 candidates per vector for each
    pivot. Beyond the square of the greatest number of pivots, about 67 million vectors, candidates grow with the vectors.
    """
    count = min(max(PIVOTS, math.isqrt(vectors)), MOST_PIVOTS)
    return count, PREFIX + math.ceil(math.log2(count / PIVOTS))


def choose_pivots(classes: DataFrame, size: int, count: int) -> np.ndarray:
    """Reference points from a bounded sample, taken in the order of a hash of their ids and kept apart.

    Near copies would describe one place many times over and part what lies there, so the first one stands for them.
    """
    most = max(SAMPLE, min(4 * count, SAMPLE_COMPONENTS // size))
    sample = classes.orderBy(F.xxhash64("low"), "low", "rep").limit(most).select("vector").collect()
    if not sample:
        return np.zeros((0, size))
    points = unit(np.array([r["vector"] for r in sample], np.float64).reshape(-1, size))
    kept = [0]
    nearest = points @ points[0]
    for i in range(1, len(points)):
        if len(kept) == count:
            break
        if nearest[i] < APART:
            kept.append(i)
            nearest = np.maximum(nearest, points @ points[i])
    return points[kept]


def described(classes: DataFrame, pivots: np.ndarray, size: int, prefix: int) -> DataFrame:
    """``key, rep, copies, vector, prefix``: each vector under each pair of its nearest pivots.

    ``prefix`` is sorted by pivot; with a single pivot all vectors are in one list.
    """
    shipped = classes.sparkSession.sparkContext.broadcast(pivots)  # of bounded size
    length = min(prefix, len(pivots))
    pairs = list(itertools.combinations(range(length), 2)) or [(0, 0)]
    schema = pa.schema([("key", pa.int32()), ("rep", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("prefix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shipped.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                rows = unit(matrix(batch.column("vector"), size))
                near = np.sort(np.argpartition(-(rows @ points.T), length - 1, axis=1)[:, :length], axis=1).astype(np.int16)
                keys = np.stack([near[:, i].astype(np.int32) * len(points) + near[:, j] for i, j in pairs], axis=1)
                at = np.repeat(np.arange(len(rows)), len(pairs))
                texts, own = [r.tobytes() for r in rows], [r.tobytes() for r in near]
                yield arrow_table(
                    {
                        "key": keys.ravel(),
                        "rep": batch.column("rep").to_numpy()[at],
                        "copies": batch.column("copies").to_numpy()[at],
                        "vector": [texts[i] for i in at],
                        "prefix": [own[i] for i in at],
                    },
                    schema,
                )

    return classes.select("rep", "copies", "vector").mapInArrow(run, "key int, rep long, copies long, vector binary, prefix binary")


def _share_smaller(prefixes: np.ndarray, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by what they have below ``second`` besides ``first``: each row's kind, and whether two kinds share a pivot."""
    below = np.where((prefixes < second) & (prefixes != first), prefixes, -1)
    kinds, kind = np.unique(below, axis=0, return_inverse=True)
    share = np.zeros((len(kinds), len(kinds)), bool)
    for i, j in itertools.product(range(kinds.shape[1]), repeat=2):
        share |= (kinds[:, i][:, None] == kinds[:, j][None, :]) & (kinds[:, i][:, None] >= 0)
    return kind.reshape(-1), share


def _links(rows: dict[str, np.ndarray], pivots: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of one block that are links and belong to this list."""
    key, side, vectors = int(rows["key"][0]), rows["side"], rows["vector"]
    kind, share = _share_smaller(rows["prefix"], key // pivots, key % pivots)
    found_x, found_y = [], []
    order = np.argsort(kind, kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(len(share) + 1))
    several = len(share) <= 32  # few kinds: compare kinds that share nothing; many: all rows at once
    for g in range(len(share) if several else 1):
        x = order[bounds[g] : bounds[g + 1]] if several else np.arange(len(side))
        others = np.flatnonzero(~share[g][g:]) + g if several else np.arange(1)
        y = np.concatenate([order[bounds[h] : bounds[h + 1]] for h in others]) if several and len(others) else x if not several else x[:0]
        if not len(x) or not len(y):
            continue
        i, j = np.nonzero(vectors[x] @ vectors[y].T >= least)
        i, j = x[i], y[j]
        ok = ~share[kind[i], kind[j]] & (i != j) & ((side[i] != side[j]) | (side[i] < 0))
        i, j = i[ok], j[ok]
        i, j = np.minimum(i, j), np.maximum(i, j)
        code = np.unique(i * np.int64(len(side)) + j)
        found_x.append(code // len(side))
        found_y.append(code % len(side))
    if not found_x:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_x), np.concatenate(found_y)


def _forest(reps: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches over links within the block."""
    label = reps.copy()
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        if (label == before).all():
            return label


def links_of(filed: DataFrame, pivots: int, size: int, least: float) -> DataFrame:
    """``rep, linked, root``: per block the linked rows of a class, and the smallest class they lead to there."""
    length = F.length("prefix")
    sizes = filed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).where(F.col("_blocks") > 1)
    counted = lookup_join(filed, materialise(sizes, "lists"), ["key"], ["rep"], "left")
    counted = counted.withColumn("blocks", F.coalesce("_blocks", F.lit(1))).drop("_blocks")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    spread = counted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = spread.select("key", low.alias("low"), high.alias("high"), "rep", "copies", "vector", "prefix", F.when(low == high, -1).otherwise(F.col("own")).alias("side")).where(length > 0)
    parts = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")
    schema = pa.schema([("rep", pa.int64()), ("linked", pa.int64()), ("root", pa.int64())])

    def told(c: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        x, y = _links(c, pivots, least)
        if not len(x):
            return None
        linked = np.zeros(len(c["rep"]), np.int64)
        np.add.at(linked, x, c["copies"][y])
        np.add.at(linked, y, c["copies"][x])
        some = linked > 0
        return arrow_table({"rep": c["rep"][some], "linked": linked[some], "root": _forest(c["rep"], x, y)[some]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "low", "high", "rep", "copies", "side")
        kept: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            c["vector"] = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float64).reshape(-1, size)
            c["prefix"] = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.int16).reshape(batch.num_rows, -1)
            if kept is not None:
                c = {k: np.concatenate([kept[k], c[k]]) for k in c}
            new = np.append(True, (c["key"][1:] != c["key"][:-1]) | (c["low"][1:] != c["low"][:-1]) | (c["high"][1:] != c["high"][:-1]))
            starts = np.flatnonzero(new)
            for a, b in itertools.pairwise(starts):
                if b - a > 1 and (out := told({k: v[a:b] for k, v in c.items()})) is not None:
                    yield out
            kept = {k: v[starts[-1] :] for k, v in c.items()}  # the last block may go on in the next batch
        if kept is not None and len(kept["rep"]) > 1 and (out := told(kept)) is not None:
            yield out

    return rows.mapInArrow(run, "rep long, linked long, root long")


def near_vectors(rows: DataFrame, least: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", count: int | None = None, prefix: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``rows``.

    ``count`` pivots, the ``prefix`` nearest of which describe a vector, are set by the number of vectors if not given (``described_by``).
    A link is a pair with a cosine of ``least`` or more that the index finds; ``n_links`` counts the other rows linked directly
    (copies of the vector are), ``component_id`` is the smallest id that links lead to, ``kept`` says that it is the row's own.
    Vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing; others with vectors of as many
    components, each length having an index of its own. An id that stands for several vectors has a row, and links, for each.
    Rows without an id take no part and are kept. An empty table gives none. Other columns are not looked at.
    """
    classes = distinct_vectors(rows, vec_id, vector)
    ids = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_vector"))
    ids = ids.withColumn("_vector", F.when(usable("_vector") & F.col("vec_id").isNotNull(), F.col("_vector")))
    none = F.col("vec_id").alias("component_id")
    blocks = []
    for size in sizes_of(classes, "vector"):
        own = classes.where(F.size("vector") == size)
        pivots_here, prefix_here = described_by(own.count())
        pivots = choose_pivots(own, size, count or pivots_here)
        blocks.append(materialise(links_of(described(own, pivots, size, prefix or prefix_here), len(pivots), size, least), "links"))
    if not blocks:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), none, F.lit(True).alias("kept"))
    found = functools.reduce(DataFrame.union, blocks)
    numbers = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    roots = materialise(classes.select("rep", "low").join(components(found.select("rep", "root")).withColumnRenamed("node", "rep"), "rep"), "roots")
    smallest = materialise(roots.groupBy("root").agg(F.min("low").alias("smallest")), "smallest")
    roots = lookup_join(roots.select("rep", "root"), smallest, ["root"], ["rep"]).select("rep", "smallest")
    told = classes.join(numbers, "rep", "left").join(roots, "rep", "left")
    told = materialise(told.select(F.col("vector").alias("_vector"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("smallest", "low").alias("_root")))
    out = ids.join(told, "_vector", "left").select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
