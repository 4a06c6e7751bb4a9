"""Greedy time buffers: a buffer closes with the first row at least ``span`` after the last close.

Where the next buffer closes depends on where the one before closed, so the rule is a chain. Each (key, segment) is
a step map from the close before it to the last close in it: the few times at which chains can enter, each with the time
at which they leave. Maps of later segments are applied to earlier ones' results by pointers: each step points to the step that takes
up where it leaves, pointers are doubled by joins, and the steps on the path from a key's first row are found in a number of
joins that is the logarithm of the path. These say which close every segment starts from; then segments are marked
independently. No key, and no table without keys, is swept by one task, however long the span is.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ferrylog.operators.ordering import SEGMENT, TARGET_ROWS, running, with_segments
from ferrylog.session import materialise


def _exits(times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible first closes of a segment and, for each, the last close reached from it.

    Chains that start close together soon meet, so few different ones are left unless the span is about as long as the segment.
    """
    count = len(times)
    after = np.searchsorted(times, times + span, side="left")
    leave = np.where(after < count, after, np.arange(count))
    while not np.array_equal(leave, further := leave[leave]):  # each turn doubles the steps taken
        leave = further
    entries = np.arange(min(after[0] + 1, count))
    at, out = times[entries], times[leave[entries]]
    # entries that leave alike are one, the last of them; the first says when the segment begins
    told = np.append(out[1:] != out[:-1], True)
    told[0] = True
    return at[told], out[told]


def _changes(batch: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """Which rows differ from the row before in some of the columns; nulls are equal."""
    changes = np.zeros(len(batch), dtype=bool)
    changes[:1] = True
    for name in names:
        col = batch[name]
        changes |= ((col != col.shift()) & ~(col.isna() & col.shift().isna())).to_numpy(dtype=bool)
    return changes


def mark_closes(times: np.ndarray, last: int, span: int, closes: np.ndarray, number: np.ndarray, count: int) -> tuple[int, int]:
    """Fill ``closes`` and ``number`` (closes before the row) of one run of rows; returns the new state."""
    begin = 0
    at = int(np.searchsorted(times, last + span, side="left"))
    while at < len(times):
        closes[at] = True
        number[begin : at + 1] = count
        last, count, begin = int(times[at]), count + 1, at + 1
        at = int(np.searchsorted(times, last + span, side="left"))
    number[begin:] = count
    return last, count


def _next_steps(steps: DataFrame, span: int, keys: Sequence[str], target_rows: int) -> DataFrame:
    """``_from, _next``: which step (by ``_id``) takes up a chain that leaves the step ``_from``; -1 is a key's first row."""
    first = steps.groupBy(*keys).agg(F.min("_at").alias("_leave")).withColumn("_id", F.lit(-1).cast("long"))
    asked = steps.select(*keys, "_leave", "_id").unionByName(first)
    places = steps.select(*keys, (-F.col("_at")).alias("_t"), F.lit(0).alias("_kind"), (-F.col(SEGMENT)).alias("_s"), "_id")
    probes = asked.select(*keys, (-F.col("_leave") - span).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_s"), "_id")
    # backwards in time, the last step passed is the first one at or after the probe, of equal times that of the first segment
    seen = {"_next": ("last", F.when(F.col("_kind") == 0, F.col("_id")))}
    found = running(places.unionByName(probes), seen, ["_t", "_kind", "_s", "_id"], keys, target_rows)
    return found.filter("_kind = 1 AND _next IS NOT NULL").select(F.col("_id").alias("_from"), "_next")


def _on_path(pointers: DataFrame) -> DataFrame:
    """``_id`` of all steps that -1 leads to; with pointers of 2**n steps, 2**n more of them each turn."""
    jumps = materialise(pointers.filter("_from >= 0"), "jumps")
    path = materialise(pointers.filter("_from < 0").select(F.col("_next").alias("_id")), "path")
    while True:
        more = materialise(path.join(jumps, F.col("_id") == F.col("_from")).select(F.col("_next").alias("_id")), "more")
        if more.isEmpty():
            return path
        path = materialise(path.union(more), "path")
        further = jumps.select(F.col("_from").alias("_next"), F.col("_next").alias("_far"))
        jumps = materialise(jumps.join(further, "_next").select("_from", F.col("_far").alias("_next")), "jumps")


def _starts(steps: DataFrame, span: int, keys: Sequence[str], target_rows: int) -> DataFrame:
    """Per (key, segment) ``_start``, the last close before it, or the key's first time."""
    path = _on_path(materialise(_next_steps(steps, span, keys, target_rows), "pointers"))
    taken = steps.join(path, "_id").select(*keys, SEGMENT, "_leave")
    begun = steps.select(*keys, SEGMENT, "_at")
    segments = begun.unionByName(taken, allowMissingColumns=True).groupBy(*keys, SEGMENT).agg(F.min("_at").alias("_at"), F.max("_leave").alias("_leave"))
    ordered = Window.partitionBy(*keys).orderBy(SEGMENT)  # a row per segment
    last = F.max("_leave").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min("_at").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return materialise(segments.select(*keys, SEGMENT, F.coalesce(last, first).alias("_start")), "starts")


def buffer_greedy(
    df: DataFrame,
    ts: str,
    span_seconds: float,
    order: Sequence[str],
    keys: Sequence[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Rows with ``buffer_id`` (from 0 per key) and ``closes`` on the row that ends its buffer.

    The clock starts with the first row of a key; the last buffer may stay open.
    """
    span = round(span_seconds * 1_000_000)
    if span < 1:
        raise ValueError("a buffer spans at least a microsecond")
    rows, split = with_segments(df.withColumn("_us", F.unix_micros(ts)), order, keys, target_rows)
    group = [*keys, SEGMENT]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    group_schema = ", ".join(f"{n} {types[n]}" for n in group)

    def entries(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at, leave = _exits(np.sort(part["_us"].to_numpy()), span)
        out = pd.DataFrame({"_at": at, "_leave": leave})
        for i, name in enumerate(group):
            out.insert(i, name, key[i])
        return out

    begun = rows.withColumn("_start", F.lit(None).cast("long"))
    if split:
        several = rows.select(*group).distinct().withColumn("_pieces", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_pieces > 1")
        same = [F.col(f"r.{n}").eqNullSafe(F.col(f"s.{n}")) for n in group]
        cut = rows.alias("r").join(several.alias("s"), same, "left_semi").select(*group, "_us")
        steps = cut.groupBy(*group).applyInPandas(entries, f"{group_schema}, _at long, _leave long")
        starts = _starts(materialise(steps.withColumn("_id", F.monotonically_increasing_id()), "steps"), span, keys, target_rows)
        begun = rows.alias("r").join(starts.alias("s"), same, "left").select("r.*", "s._start")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows arrive sorted by group and time; a group may go on in the next batch
        current, last, count = None, 0, 0
        for batch in batches:
            times, starts = batch["_us"].to_numpy(), batch["_start"].to_numpy(dtype="float64", na_value=np.nan)
            changes = _changes(batch, group)
            closes, number = np.zeros(len(batch), dtype=bool), np.zeros(len(batch), dtype=np.int64)
            bounds = [*np.flatnonzero(changes), len(batch)]
            for a, b in zip(bounds, bounds[1:]):
                key = tuple(None if pd.isna(v) else v for v in batch[group].iloc[a]) if a == 0 else None
                if key is None or key != current:
                    last, count = int(times[a]) if np.isnan(starts[a]) else int(batch["_start"].iloc[a]), 0
                last, count = mark_closes(times[a:b], last, span, closes[a:b], number[a:b], count)
            current = tuple(None if pd.isna(v) else v for v in batch[group].iloc[-1])
            yield batch.assign(closes=closes, _n=number)

    marked_schema = T.StructType([*begun.schema.fields, T.StructField("closes", T.BooleanType()), T.StructField("_n", T.LongType())])
    sorted_rows = begun.repartition(*group).sortWithinPartitions(*group, "_us", *order)
    marked = sorted_rows.mapInPandas(mark, marked_schema).drop("_us", "_start")
    if not split:
        return marked.withColumn("buffer_id", F.col("_n")).drop(SEGMENT, "_n")
    marked = materialise(marked, "marked")  # read twice below
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    closed = marked.groupBy(*group).agg(F.sum(F.col("closes").cast("long")).alias("_c"))
    offsets = closed.select(*group, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    same = [F.col(f"m.{n}").eqNullSafe(F.col(f"o.{n}")) for n in group]
    joined = marked.alias("m").join(offsets.alias("o"), same, "left").select("m.*", "o._before")
    return joined.withColumn("buffer_id", F.col("_n") + F.coalesce("_before", F.lit(0))).drop(SEGMENT, "_n", "_before")
