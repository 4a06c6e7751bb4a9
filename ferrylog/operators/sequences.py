"""Operators over ordered rows: skip, zip, batch, windows, scan, throttle, debounce, buffers, EMA.

``order`` names columns that together fix the order (end it with a unique column). With
``keys`` every key is a sequence of its own; without, the whole table is one sequence.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrylog.operators.ordering import (
    SEGMENT,
    TARGET_ROWS,
    neighbours,
    running,
    running_in,
    with_segments,
    with_seq,
)
from ferrylog.operators.rows import keep_first
from ferrylog.session import materialise


def skip(df: DataFrame, count: int, order: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """All rows but the first ``count``, keeping their position in ``seq``."""
    return with_seq(df, order, target_rows=target_rows).filter(F.col("seq") > count)


def zip_rows(
    sources: Sequence[tuple[DataFrame, Sequence[str]]], target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Pair rows by position; stops at the shortest input. Column names must differ between inputs."""
    numbered = [with_seq(df, order, target_rows=target_rows) for df, order in sources]
    out = numbered[0]
    for nxt in numbered[1:]:
        out = out.join(nxt, "seq")
    return out


def group_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Rows with their position inside their group, in arrival order."""
    return with_seq(df, order, keys, "position", target_rows)


def batch(
    df: DataFrame,
    size: int,
    order: Sequence[str],
    keys: Sequence[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Consecutive groups of ``size`` rows (the last may be short): ``batch_id`` and ``pos``, from 0."""
    back = F.col("seq") - 1
    rows = with_seq(df, order, keys, target_rows=target_rows)
    return rows.withColumns({"batch_id": F.floor(back / F.lit(size)).cast("long"), "pos": back % size}).drop("seq")


def batch_arrays(batched: DataFrame, item: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Batches as arrays; each is at most one batch long."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("pos"), item.alias("item"))))
    return batched.groupBy(*keys, "batch_id").agg(F.transform(ordered, lambda r: r["item"]).alias("items"))


def sliding_window(
    df: DataFrame, size: int, order: Sequence[str], step: int = 1, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Full windows only: each row is copied to the windows it belongs to (``window_id``, ``pos``).

    Window k covers seq k*step+1 .. k*step+size. No window is gathered in one place, and the
    total row count decides which windows are full.
    """
    seq = F.col("seq")
    first = F.greatest(F.lit(0), F.ceil((seq - size) / F.lit(step))).cast("long")
    last = F.floor((seq - 1) / F.lit(step)).cast("long")
    total = df.count()
    rows = with_seq(df, order, target_rows=target_rows)
    last = F.least(last, F.lit(math.floor((total - size) / step)).cast("long"))
    spread = rows.withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last))))
    return spread.withColumn("pos", seq - 1 - F.col("window_id") * step)


def distinct_until_changed(
    df: DataFrame,
    value: Column,
    order: Sequence[str],
    keys: Sequence[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Drop a row whose value equals that of the row before; the first row always stays."""
    # a struct tells "no row before" (NULL) from "the row before held NULL"
    seen = neighbours(df.withColumn("_value", F.struct(value)), order, keys, {"_before": F.col("_value")}, target_rows=target_rows)
    return seen.filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_value"))).drop("_value", "_before")


def scan(
    df: DataFrame,
    folds: dict[str, tuple[str, Column, object]],
    order: Sequence[str],
    keys: Sequence[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """The initial value (seq 0), then every running value: n + 1 rows per sequence.

    ``folds`` maps a name to (``sum``/``min``/``max``, value, initial value).
    """
    combine = {
        "sum": lambda initial, col: col + initial,
        "min": lambda initial, col: F.least(initial, col),
        "max": lambda initial, col: F.greatest(initial, col),
    }
    rows = running(
        df,
        {"seq": ("sum", F.lit(1).cast("long")), **{n: (kind, col) for n, (kind, col, _) in folds.items()}},
        order,
        keys,
        target_rows,
    )
    values = [
        F.coalesce(combine[kind](F.lit(initial), F.col(n)), F.lit(initial)).alias(n)
        for n, (kind, _, initial) in folds.items()
    ]
    rows = rows.select(*keys, "seq", *values)
    seeds = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    seeds = seeds.select(*keys, F.lit(0).cast("long").alias("seq"), *[F.lit(i).alias(n) for n, (_, _, i) in folds.items()])
    return seeds.unionByName(rows)


def fold_segments(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str],
    step: Callable[[pd.DataFrame], pd.DataFrame],
    state_schema: str,
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """An order-dependent fold given as Python functions, like an aggregator's reduce and merge.

    ``step`` folds one segment's rows (sorted) to one state row; ``merge`` folds a key's state
    rows (sorted by segment) to one, and is not asked where there is one. ``step`` sees a segment, ``merge`` a row per segment.
    """
    rows, split = with_segments(df, order, keys, target_rows)
    names = [*keys, SEGMENT]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_schema = ", ".join(f"{n} {types[n]}" for n in names)

    def reduce_segment(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = step(part.sort_values(list(order), kind="stable"))
        for i, n in enumerate(names):
            out.insert(i, n, key[i])
        return out

    def merge_states(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = merge(part.sort_values(SEGMENT).drop(columns=names))
        for i, n in enumerate(keys):
            out.insert(i, n, key[i])
        return out

    partial = rows.groupBy(*names).applyInPandas(reduce_segment, f"{key_schema}, {state_schema}")
    if not split:
        return partial.drop(SEGMENT)
    final_schema = ", ".join([*[f"{n} {types[n]}" for n in keys], state_schema])
    states = materialise(partial.withColumn("_states", F.count(F.lit(1)).over(Window.partitionBy(*keys))), "states")
    alone, several = (states.filter(condition).drop("_states") for condition in ("_states = 1", "_states > 1"))
    return alone.drop(SEGMENT).unionByName(several.groupBy(*keys).applyInPandas(merge_states, final_schema))


def throttle(
    df: DataFrame,
    ts: str,
    interval_seconds: float,
    order: Sequence[str],
    keys: Sequence[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Every row, with ``emit_us``: emissions are at least the interval apart, in order.

    The waiting rule emit(i) = max(ts(i), emit(i-1) + d) has the closed form
    max over j <= i of (ts(j) - j*d) + i*d.
    """
    gap = F.lit(round(interval_seconds * 1_000_000)).cast("long")
    rows, split = with_segments(df, order, keys, target_rows)
    rows = running_in(rows, split, {"_i": ("sum", F.lit(1).cast("long"))}, order, keys)
    rows = running_in(rows, split, {"_slack": ("max", F.unix_micros(ts) - F.col("_i") * gap)}, order, keys)
    return rows.withColumn("emit_us", F.col("_slack") + F.col("_i") * gap).drop("_i", "_slack", SEGMENT)


def debounce(
    df: DataFrame,
    ts: str,
    delay_seconds: float,
    order: Sequence[str],
    keys: Sequence[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Rows with no newer row within the delay."""
    micros = F.unix_micros(ts)
    rows = neighbours(df, order, keys, following={"_next": micros}, target_rows=target_rows)
    quiet = F.col("_next").isNull() | (F.col("_next") - micros >= round(delay_seconds * 1_000_000))
    return rows.filter(quiet).drop("_next")


def buffer_tumbling(df: DataFrame, ts: str, span: str, aggregates: dict[str, Column], keys: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Aggregates per time span (``slide`` makes the spans overlap); also runs on streams with a watermark."""
    spans = F.window(ts, span, slide) if slide else F.window(ts, span)
    out = df.groupBy(*keys, spans.alias("_span")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("_span.start").alias("span_start"), F.col("_span.end").alias("span_end"), *aggregates)


def buffer_session(
    df: DataFrame,
    ts: str,
    gap_seconds: float,
    aggregates: dict[str, Column],
    keys: Sequence[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Aggregates per run of rows closer together than the gap; the span ends one gap after its last row.

    In a batch the runs are numbered first, so neither a hot key nor a long run ends up in one
    task. A stream (give it a watermark) keeps its runs in Spark's session windows.
    """
    if df.isStreaming:
        runs = df.groupBy(*keys, F.session_window(ts, f"{gap_seconds} seconds").alias("_span"))
        out = runs.agg(*[c.alias(n) for n, c in aggregates.items()])
        return out.select(*keys, F.col("_span.start").alias("span_start"), F.col("_span.end").alias("span_end"), *aggregates)
    gap = round(gap_seconds * 1_000_000)
    rows = neighbours(df, [ts], keys, {"_before": F.unix_micros(ts)}, target_rows=target_rows)
    apart = F.when(F.unix_micros(ts) - F.col("_before") < gap, F.lit(0)).otherwise(F.lit(1)).cast("long")
    rows = running(rows.withColumn("_apart", apart), {"_run": ("sum", F.col("_apart"))}, [ts, "_before"], keys, target_rows)
    out = rows.groupBy(*keys, "_run").agg(
        F.min(ts).alias("span_start"),
        F.timestamp_micros(F.max(F.unix_micros(ts)) + gap).alias("span_end"),
        *[c.alias(n) for n, c in aggregates.items()],
    )
    return out.drop("_run")


def sample_per_interval(df: DataFrame, ts: str, rate: float, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """At most one row per 1/rate seconds: the first of each time cell."""
    cell = F.floor(F.unix_micros(ts) / F.lit(1_000_000 / rate)).cast("long")
    return keep_first(df.withColumn("cell", cell), [*keys, "cell"], order)


def keep_newest(df: DataFrame, count: int, order: Sequence[str], keys: Sequence[str] = (), target_rows: int = TARGET_ROWS) -> DataFrame:
    """The newest ``count`` rows per key, newest first in ``rank``.

    Rows are cut into segments first and each (key, segment) keeps its newest ``count``, so a hot key meets in one place with at
    most that many rows per segment, then in pieces again if that is still long.
    """
    newest = [F.col(c).desc() for c in order]
    rows, split = with_segments(df, order, keys, target_rows)
    if split:
        own = F.row_number().over(Window.partitionBy(*keys, SEGMENT).orderBy(*newest))
        rows = rows.withColumn("_own", own).filter(F.col("_own") <= count).drop("_own")
        # a segment counts only if the segments after it have not filled the quota
        kept = rows.groupBy(*keys, SEGMENT).agg(F.count(F.lit(1)).alias("_n"))
        after = Window.partitionBy(*keys).orderBy(F.col(SEGMENT).desc()).rowsBetween(Window.unboundedPreceding, -1)
        kept = kept.withColumn("_later", F.coalesce(F.sum("_n").over(after), F.lit(0))).filter(F.col("_later") < count)
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in (*keys, SEGMENT)]
        rows = rows.alias("l").join(kept.alias("t"), same).select("l.*", "t._later")
        own = F.row_number().over(Window.partitionBy(*keys, SEGMENT).orderBy(*newest))
        return rows.withColumn("rank", own + F.col("_later")).filter(F.col("rank") <= count).drop("_later", SEGMENT)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest)).cast("long")
    return rows.drop(SEGMENT).withColumn("rank", rank).filter(F.col("rank") <= count)


#: What is left of an average after so many values that no double would show it.
NOTHING = 1e-60


def moving_average_exponential(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    keys: Sequence[str] = (),
    alpha: float = 0.1,
    target_rows: int = TARGET_ROWS,
    block_rows: int = 100_000,
) -> DataFrame:
    """EMA: the first value seeds it, then alpha*x + (1-alpha)*previous; a null value leaves the average as it was.

    Values that are not null are numbered and cut into blocks: so short that powers of q = 1-alpha stay within double precision, and
    no longer than ``block_rows``. Within a block the average is a weighted running sum. A block's closing average is a linear
    function of the one before, a = c + q**length * a', and such functions compose: closings are found by the same rule over blocks,
    blocks of blocks, and so on, until one block holds them all.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    known = F.col(value).isNotNull()
    rows, split = with_segments(df, order, keys, target_rows)
    number = {"_i": ("sum", F.when(known, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))}
    rows = running_in(rows, split, number, order, keys).drop(SEGMENT)
    return _ema(rows, F.col(value).cast("double"), known, keys, alpha, block_rows, split)


def _ema(rows: DataFrame, value: Column, known: Column, keys: Sequence[str], alpha: float, block_rows: int, split: bool) -> DataFrame:
    q = 1.0 - alpha
    longest = block_rows if q in (0.0, 1.0) else min(block_rows, math.ceil(math.log(1e-100) / math.log(q)))
    size = max(2, longest)
    # x_i: what the i-th value adds, so that the average is the sum of x_j * q**(i - j)
    rows = rows.withColumns(
        {
            "_x": F.when(known, F.when(F.col("_i") == 1, value).otherwise(value * alpha)),
            "_block": F.floor((F.col("_i") - 1) / F.lit(size)).cast("long"),
            "_pos": F.when(F.col("_i") > 0, (F.col("_i") - 1) % size),
        }
    )
    if q == 0.0:
        return _last_known(rows, keys).drop("_i", "_x", "_block", "_pos")
    placed = [F.col("_i"), F.col("_x").isNull()]
    upto = Window.partitionBy(*keys, "_block").orderBy(*placed).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.coalesce("_x", F.lit(0.0)) * F.pow(F.lit(q), -F.col("_pos"))).over(upto)
    ema = (own + F.coalesce("_in", F.lit(0.0)) * q) * F.pow(F.lit(q), F.col("_pos"))
    if not split and q**size < NOTHING:
        # a key lies in one task and only the block before counts: its closing is carried over by windows
        closing = F.sum(F.col("_x") * F.pow(F.lit(q), -F.col("_pos"))).over(Window.partitionBy(*keys, "_block")) * F.pow(F.lit(q), F.lit(size - 1))
        before = rows.withColumn("_own", closing).withColumn("_own", F.lag("_own").over(Window.partitionBy(*keys).orderBy(*placed)))
        joined = before.withColumn("_in", F.first("_own").over(upto)).drop("_own")
        return joined.withColumn("ema", F.when(F.col("_i") > 0, ema)).drop("_i", "_x", "_block", "_pos", "_in")
    filed = rows.filter(F.col("_x").isNotNull())
    scaled = F.sum(F.col("_x") * F.pow(F.lit(q), -F.col("_pos")))
    closings = filed.groupBy(*keys, "_block").agg((scaled * F.pow(F.lit(q), F.lit(size - 1))).alias("_own"))
    carried = _carried(materialise(closings, "closings"), keys, q**size, block_rows)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_block")]
    joined = rows.alias("l").join(carried.alias("c"), same, "left").select("l.*", "c._in")
    return joined.withColumn("ema", F.when(F.col("_i") > 0, ema)).drop("_i", "_x", "_block", "_pos", "_in")


def _last_known(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """With alpha 1 the average is the last value: one value per number."""
    values = rows.filter(F.col("_x").isNotNull()).select(*keys, "_i", F.col("_x").alias("ema"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"v.{k}")) for k in (*keys, "_i")]
    return rows.alias("l").join(values.alias("v"), same, "left").select("l.*", "v.ema")


def _carried(closings: DataFrame, keys: Sequence[str], factor: float, block_rows: int) -> DataFrame:
    """``_block, _in``: the average before each block, from every block's own closing sum ``_own``.

    The average after block b is the sum of ``_own`` of block j times factor**(b - j). Where the factor has vanished, only the block before
    matters; elsewhere blocks are summed in groups, and the groups' sums are carried on by the same rule.
    """
    if factor < NOTHING:
        return closings.select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_own").alias("_in"))
    reach = block_rows if factor == 1.0 else max(2, min(block_rows, math.ceil(math.log(1e-100) / math.log(factor))))
    spans = closings.withColumns({"_group": F.floor(F.col("_block") / F.lit(reach)).cast("long"), "_at": F.col("_block") % reach})
    upto = Window.partitionBy(*keys, "_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    power = lambda n: F.pow(F.lit(factor), n)
    before = F.sum(F.col("_own") * power(-F.col("_at"))).over(upto) * power(F.col("_at") - 1)
    inside = spans.withColumn("_before", F.coalesce(before, F.lit(0.0)))
    groups = materialise(spans.groupBy(*keys, F.col("_group").alias("_block")).agg(F.sum(F.col("_own") * power(reach - 1 - F.col("_at"))).alias("_own")), "closings")
    if groups.filter("_block > 0").isEmpty():
        return inside.select(*keys, "_block", F.col("_before").alias("_in"))
    upper = _carried(groups, keys, factor**reach, block_rows).select(*keys, F.col("_block").alias("_group"), F.col("_in").alias("_far"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"u.{k}")) for k in (*keys, "_group")]
    joined = inside.alias("l").join(upper.alias("u"), same, "left").select("l.*", "u._far")
    return joined.select(*keys, "_block", (F.col("_before") + F.coalesce("_far", F.lit(0.0)) * power(F.col("_at"))).alias("_in"))
