"""Order-dependent operators that survive hot keys.

A window partitioned by key puts all rows of that key into one task. Here a table longer than
``target_rows`` is first cut into *segments* of about that length: Spark's range partitioning by the keys
and all order columns, at their full width, says where. A hot key then lies in as many segments as
its rows fill, whatever its values look like; a table without keys is cut the same way. Windows run per (keys, segment); what a
segment needs from the ones before it is carried in by one extra row per (key, segment), computed from
a small partial-aggregated summary. Keys that lie in one segment get no such row.

The segment numbers are written with the rows, so a retried task never meets other cuts than the
tasks before it. A table no longer than ``target_rows`` keeps the plain keyed window. Sums of doubles are therefore
associated differently above and below that length; sum decimals or integers where equality matters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrylog.session import materialise

SEGMENT = "_segment"
WHOLE = -1  # the segment of rows of a table that is not cut
_PLACE = "_place"  # 0 carried-in row, 1 data row, 2 carried-back row
TARGET_ROWS = 1_000_000


def with_segments(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), target_rows: int = TARGET_ROWS
) -> tuple[DataFrame, bool]:
    """Add the segment column; the flag says whether anything was cut.

    Counts the rows up front. A longer table is written once, dealt out by ranges of keys and order; segment
    numbers rise along that order. ``order`` must end in a column that tells rows of a key apart.
    """
    total = df.select(*order).count()
    if total <= target_rows:
        return df.withColumn(SEGMENT, F.lit(WHOLE).cast("long")), False
    ranged = df.repartitionByRange(math.ceil(total / target_rows), *[F.col(c).asc_nulls_first() for c in (*keys, *order)])
    return materialise(ranged.withColumn(SEGMENT, F.spark_partition_id().cast("long")), "segments"), True


def _fold(kind: str, col: Column) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col)


def running_in(
    rows: DataFrame,
    split: bool,
    folds: dict[str, tuple[str, Column]],
    order: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """``running`` over rows that carry their segment already; keeps the segment column."""
    inputs = {f"_in_{name}": expr for name, (_, expr) in folds.items()}
    rows = rows.withColumns({**inputs, _PLACE: F.lit(1)})
    if split:
        last_place = {n: F.when(F.col(f"_in_{n}").isNotNull(), F.struct(*order)) for n in folds}
        summary = rows.groupBy(*keys, SEGMENT).agg(
            *[
                (F.max_by(F.col(f"_in_{n}"), last_place[n]) if kind == "last" else _fold(kind, F.col(f"_in_{n}"))).alias(f"_in_{n}")
                for n, (kind, _) in folds.items()
            ]
        )
        before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        carried = summary.select(
            *keys,
            SEGMENT,
            *[_fold(kind, F.col(f"_in_{n}")).over(before).alias(f"_in_{n}") for n, (kind, _) in folds.items()],
            F.lit(0).alias(_PLACE),
            F.count(F.lit(1)).over(before).alias("_earlier"),
        )
        rows = rows.unionByName(carried.filter("_earlier > 0").drop("_earlier"), allowMissingColumns=True)
    upto = (
        Window.partitionBy(*keys, SEGMENT)
        .orderBy(_PLACE, *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumns({n: _fold(kind, F.col(f"_in_{n}")).over(upto) for n, (kind, _) in folds.items()})
    return rows.filter(F.col(_PLACE) == 1).drop(_PLACE, *inputs)


def running(
    df: DataFrame,
    folds: dict[str, tuple[str, Column]],
    order: Sequence[str],
    keys: Sequence[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Running ``sum``/``min``/``max``/``last`` (non-null) up to and including each row."""
    rows, split = with_segments(df, order, keys, target_rows)
    return running_in(rows, split, folds, order, keys).drop(SEGMENT)


def with_seq(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "seq",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Number rows 1, 2, 3 ... in order, per key or over the whole table."""
    return running(df, {name: ("sum", F.lit(1).cast("long"))}, order, keys, target_rows)


def neighbours(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Values of the row before and the row after; NULL where there is none."""
    previous, following = previous or {}, following or {}
    inputs = {f"_in_{n}": c for n, c in {**previous, **following}.items()}
    rows, split = with_segments(df.withColumns(inputs), order, keys, target_rows)
    rows = rows.withColumn(_PLACE, F.lit(1))
    if split:
        place = F.struct(*order)
        ends = rows.groupBy(*keys, SEGMENT).agg(
            *[F.max_by(F.struct(f"_in_{n}"), place).alias(f"_in_{n}") for n in previous],
            *[F.min_by(F.struct(f"_in_{n}"), place).alias(f"_in_{n}") for n in following],
        )
        by_segment = Window.partitionBy(*keys).orderBy(SEGMENT)
        for names, move, mark in ((previous, F.lag, 0), (following, F.lead, 2)):
            if names:
                carried = ends.select(
                    *keys,
                    SEGMENT,
                    *[move(f"_in_{n}").over(by_segment)[f"_in_{n}"].alias(f"_in_{n}") for n in names],
                    F.lit(mark).alias(_PLACE),
                    move(F.lit(True)).over(by_segment).alias("_other"),
                )
                rows = rows.unionByName(carried.filter("_other").drop("_other"), allowMissingColumns=True)
    w = Window.partitionBy(*keys, SEGMENT).orderBy(_PLACE, *order)
    found = {n: F.lag(f"_in_{n}").over(w) for n in previous}
    found.update({n: F.lead(f"_in_{n}").over(w) for n in following})
    return rows.withColumns(found).filter(F.col(_PLACE) == 1).drop(SEGMENT, _PLACE, *inputs)


def framed(
    df: DataFrame,
    columns: dict[str, tuple[Column, int, int]],
    keys: Sequence[str],
    lookback: int,
    seq: str = "seq",
    block_rows: int = 100_000,
) -> DataFrame:
    """Aggregates over the last rows: ``name -> (aggregate, first offset, last offset)``.

    ``seq`` numbers the rows per key. Rows are grouped into blocks of ``block_rows`` and the
    last ``lookback`` rows of a block are copied into the next one, so every frame is complete
    inside a block and no task holds more than one block of a key at a time.
    """
    size = max(block_rows, 2 * lookback, 1)
    own = F.floor((F.col(seq) - 1) / F.lit(size)).cast("long")
    near_end = (F.col(seq) - 1) % size >= size - lookback
    rows = df.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(near_end, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    w = Window.partitionBy(*keys, "_block").orderBy(seq)
    rows = rows.withColumns({n: agg.over(w.rowsBetween(lo, hi)) for n, (agg, lo, hi) in columns.items()})
    return rows.filter(F.col("_block") == F.col("_own")).drop("_own", "_block")
