"""Reading vectors: which take part, and as what bytes they travel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylog.session import materialise


def usable(vector: str) -> Column:
    """Not null or empty, without null or non-finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def sizes_of(rows: DataFrame, vector: str) -> list[int]:
    """The numbers of components that vectors have, of which a table has few: each is indexed on its own."""
    return sorted(r["size"] for r in rows.select(F.size(vector).alias("size")).distinct().collect())


def distinct_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vector, rep, low, copies`` of the usable vectors: a number of its own, the smallest id and the rows of each; rows without an id take no part."""
    chosen = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector"))
    classes = chosen.groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    return materialise(classes.select("vector", F.monotonically_increasing_id().alias("rep"), "low", "copies"), "vectors")


def matrix(column, size: int) -> np.ndarray:
    """The rows of an Arrow list column, all of ``size`` components."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(-1, size)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
