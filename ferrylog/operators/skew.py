"""Joins whose probe side may hold a hot key."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylog.session import materialise

HOT_ROWS = 2_000_000
BROADCAST_ROWS = 100_000
_SALT, _SALTS = "_salt", "_salts"
KEEPS_PROBE = ("inner", "left", "left_semi", "left_anti")


def _checked(how: str) -> None:
    if how not in KEEPS_PROBE:
        raise ValueError(f"{how} would repeat unmatched rows of the copied side")


def hot_keys(rows: DataFrame, on: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``min_rows`` rows, with the number of pieces of that size they make; null keys match nothing and are none."""
    known = rows.dropna(subset=list(on))
    counted = known.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_rows)
    return counted.select(*on, F.ceil(F.col("_n") / min_rows).cast("int").alias(_SALTS))


def _known_small(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows, which is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def skew_join(
    rows: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    min_rows: int = HOT_ROWS,
    max_broadcast: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join two sides of any size; a key that is hot in ``rows`` is spread over pieces of ``min_rows``.

    For joins that adaptive skew handling cannot split, such as those whose result is grouped by the key at once. ``rows`` is written
    once and counted there; without a hot key it is a plain join. Only hot keys are copied on the other side. Their list is broadcast
    only after its size was checked. Rows are spread by a hash of ``spread_by`` (unique columns), so a retried task places every row
    where it was before; rows with a null key, which match nothing, are spread likewise.
    """
    _checked(how)
    rows = materialise(rows, "probe")
    hot = materialise(hot_keys(rows, on, min_rows), "hot")
    if hot.isEmpty():
        return rows.join(other, list(on), how)
    listed = _known_small(hot, max_broadcast)
    unmatched = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    piece = F.pmod(F.xxhash64(*spread_by), F.col(_SALTS)).cast("int")
    spread = F.when(unmatched, F.pmod(F.xxhash64(*spread_by), F.lit(1 << 30)).cast("int")).otherwise(F.coalesce(piece, F.lit(0)))
    copies = F.when(F.col(_SALTS).isNotNull(), F.sequence(F.lit(0), F.col(_SALTS) - 1)).otherwise(F.array(F.lit(0)))
    left = rows.join(listed, list(on), "left").withColumn(_SALT, spread).drop(_SALTS)
    right = other.join(listed, list(on), "left").withColumn(_SALT, F.explode(copies)).drop(_SALTS)
    return left.join(right, [*on, _SALT], how).drop(_SALT)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    max_broadcast: int = BROADCAST_ROWS,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join to a lookup with few distinct keys, each of them hot.

    The lookup is counted; up to ``max_broadcast`` rows it is broadcast, beyond that each key of ``rows`` is spread by its own size.
    """
    _checked(how)
    if lookup.limit(max_broadcast + 1).count() <= max_broadcast:
        return rows.join(F.broadcast(lookup), list(on), how)
    return skew_join(rows, lookup, on, spread_by, how, min_rows, max_broadcast)
