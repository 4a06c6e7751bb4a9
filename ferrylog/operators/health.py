"""Service health and congestion, computed from call logs and metric samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylog.operators.ordering import SEGMENT, TARGET_ROWS, framed, running, running_in, with_segments

# fixed values: thresholds and presets
FALLBACK_TTL_SECONDS = 300
TRIP_THRESHOLD = 5
UNHEALTHY_AFTER = 3
HEALTHY_FAILURE_RATE = 0.1
CONGESTION_THRESHOLD = 0.8
LATENCY_INCREASE = 1.5
MEASUREMENTS = 100
RECENT = 10
HISTORY = 20
MIN_RATE, MAX_RATE = 1.0, 1000.0


def last_known_good(
    df: DataFrame,
    value: Column,
    ts: str,
    order: Sequence[str],
    keys: Sequence[str],
    ttl_seconds: float = FALLBACK_TTL_SECONDS,
    default: Column | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """``result`` and where it came from: primary, cache (younger than the TTL), default, or error."""
    good = F.when(F.col("_value").isNotNull(), F.struct(F.col("_value").alias("value"), F.unix_micros(ts).alias("us")))
    rows = running(df.withColumn("_value", value), {"_kept": ("last", good)}, order, keys, target_rows)
    fresh = F.unix_micros(ts) - F.col("_kept.us") < round(ttl_seconds * 1_000_000)
    cached = F.when(fresh, F.col("_kept.value"))
    spare = default if default is not None else F.lit(None)
    source = (
        F.when(F.col("_value").isNotNull(), "primary")
        .when(cached.isNotNull(), "cache")
        .when(spare.isNotNull(), "default")
        .otherwise("error")
    )
    return rows.withColumns({"result": F.coalesce("_value", cached, spare), "result_source": source}).drop("_value", "_kept")


def _runs_in(rows: DataFrame, split: bool, ok: Column, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    rows = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    rows = running_in(rows, split, {"_i": ("sum", F.lit(1).cast("long"))}, order, keys)
    rows = running_in(rows, split, {"_good": ("max", F.when(F.col("_ok"), F.col("_i")))}, order, keys)
    since = F.col("_i") - F.coalesce("_good", F.lit(0))
    return rows.withColumn("consecutive_failures", since).drop("_ok", "_i", "_good")


def failure_runs(
    calls: DataFrame, ok: Column, order: Sequence[str], keys: Sequence[str], target_rows: int = TARGET_ROWS
) -> DataFrame:
    """``consecutive_failures`` after each call: calls since the last success, 0 on success."""
    rows, split = with_segments(calls, order, keys, target_rows)
    return _runs_in(rows, split, ok, order, keys).drop(SEGMENT)


def trips(runs: DataFrame, threshold: int = TRIP_THRESHOLD) -> DataFrame:
    """The failure at which each run reaches the threshold."""
    return runs.filter(F.col("consecutive_failures") == threshold)


def service_status(
    calls: DataFrame,
    ok: Column,
    order: Sequence[str],
    keys: Sequence[str],
    failures: int = UNHEALTHY_AFTER,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Status after each call: healthy on success, unhealthy after enough failures in a row, else as before."""
    rows, split = with_segments(calls, order, keys, target_rows)
    runs = _runs_in(rows, split, ok, order, keys)
    decided = F.when(F.col("consecutive_failures") == 0, "healthy").when(F.col("consecutive_failures") >= failures, "unhealthy")
    rows = running_in(runs, split, {"status": ("last", decided)}, order, keys).drop(SEGMENT)
    return rows.withColumn("status", F.coalesce("status", F.lit("unknown")))


def service_rollup(
    calls: DataFrame, ok: Column, ts: str, order: Sequence[str], keys: Sequence[str], target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Per service: requests, success percentage, current failure run, last failure."""
    runs = failure_runs(calls.withColumn("_up", F.coalesce(ok, F.lit(False))), F.col("_up"), order, keys, target_rows)
    rolled = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"),
        (F.count_if(F.col("_up")) / F.count(F.lit(1)) * 100).alias("success_rate"),
        F.max_by("consecutive_failures", F.struct(*order)).alias("consecutive_failures"),
        F.max(F.when(~F.col("_up"), F.col(ts))).alias("last_failure"),
    )
    return rolled


def handler_metrics(log: DataFrame, ts: str = "processed_at", span: str = "1 minute") -> DataFrame:
    """Per handler and time span, from the processing log: counts, mean time, throughput, health."""
    seconds = F.unix_seconds(F.col("_w.end")) - F.unix_seconds(F.col("_w.start"))
    failed, done = F.col("processing_status") == "failed", F.col("processing_status") == "processed"
    counted = log.groupBy("handler_name", F.window(ts, span).alias("_w")).agg(
        F.count_if(done).alias("processed"),
        F.count_if(failed).alias("failed"),
        F.count_if(F.col("processing_status") == "retried").alias("retried"),
        F.avg(F.when(done, F.col("processing_time_ms"))).alias("mean_time_ms"),
    )
    rate = F.col("failed") / F.greatest(F.col("processed"), F.lit(1))
    return counted.select(
        "handler_name",
        F.col("_w.start").alias("span_start"),
        "processed",
        "failed",
        "retried",
        "mean_time_ms",
        (F.col("processed") / seconds).alias("throughput"),
        (rate < HEALTHY_FAILURE_RATE).alias("healthy"),
    )


def congestion_flags(metrics: DataFrame, keys: Sequence[str] = ("source",), block_rows: int = 100_000) -> DataFrame:
    """Three indicators per sample (queue, latency, throughput); congested when two of them hold.

    ``seq`` numbers the samples per source from 1.
    """
    back = MEASUREMENTS - 1
    seq = F.col("seq")
    rows = framed(
        metrics,
        {
            "_latency": (F.avg("latency"), 1 - RECENT, 0),
            "_throughput": (F.avg("throughput"), 1 - RECENT, 0),
            "_oldest": (F.avg("latency"), -back, RECENT - MEASUREMENTS),
            "_first": (F.avg(F.when(seq <= RECENT, F.col("latency"))), -back, 0),
        },
        keys,
        back,
        block_rows=block_rows,
    )
    base = F.when(seq >= MEASUREMENTS, F.col("_oldest")).when(seq >= 2 * RECENT, F.col("_first")).otherwise(F.col("_latency"))
    queue = (F.col("queue_length") > 0) & (F.try_divide(F.col("queue_length"), F.col("rate") * 2) > CONGESTION_THRESHOLD)
    latency = (seq >= RECENT) & (base > 0) & (F.try_divide(F.col("_latency"), base) > LATENCY_INCREASE)
    throughput = (seq >= RECENT) & (F.col("_throughput") < F.col("rate") * 0.8)
    flags = {
        "queue_flag": F.coalesce(queue, F.lit(False)),
        "latency_flag": F.coalesce(latency, F.lit(False)),
        "throughput_flag": F.coalesce(throughput, F.lit(False)),
    }
    rows = rows.withColumns(flags).drop("_latency", "_throughput", "_oldest", "_first")
    votes = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return rows.withColumn("congested", votes >= 2)


def _clamp(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def congestion_severity(metrics: DataFrame, keys: Sequence[str] = ("source",), block_rows: int = 100_000) -> DataFrame:
    """Mean of the queue, latency and throughput factors that can be computed, each within 0..1."""
    back = MEASUREMENTS - 1
    rows = framed(metrics, {"_base": (F.avg("latency"), -back, 0)}, keys, back, block_rows=block_rows)
    moving = F.col("rate") > 0
    factors = F.array(
        F.when(moving, F.least(F.lit(1.0), F.try_divide(F.col("queue_length"), F.col("rate") * 5))),
        F.when((F.col("seq") >= 2) & (F.col("_base") > 0), _clamp((F.try_divide(F.col("latency"), F.col("_base")) - 1) / 2)),
        F.when(moving, _clamp(1 - F.try_divide(F.col("throughput"), F.col("rate")))),
    )
    known = F.filter(factors, lambda f: f.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, f: a + f)
    return rows.withColumn("severity", F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0))).drop("_base")


def suggested_rate(
    metrics: DataFrame,
    keys: Sequence[str] = ("source",),
    min_rate: float = MIN_RATE,
    max_rate: float = MAX_RATE,
    block_rows: int = 100_000,
) -> DataFrame:
    """Raise or lower the rate by the slope of throughput on rate over the last samples.

    NULL with too few samples or a constant rate.
    """
    back = HISTORY - 1
    rows = framed(
        metrics,
        {
            "_x": (F.sum("rate"), -back, 0),
            "_y": (F.sum("throughput"), -back, 0),
            "_xy": (F.sum(F.col("rate") * F.col("throughput")), -back, 0),
            "_low": (F.min("rate"), -back, 0),
            "_high": (F.max("rate"), -back, 0),
        },
        keys,
        back,
        block_rows=block_rows,
    )
    known = (F.col("seq") >= HISTORY) & (F.col("_low") < F.col("_high"))
    # the slope's sign, from plain sums: exact where rates and throughputs are whole numbers
    rising = F.col("_xy") * HISTORY - F.col("_x") * F.col("_y") > 0
    step = F.when(rising, F.least(F.lit(max_rate), F.col("rate") * 1.2)).otherwise(
        F.greatest(F.lit(min_rate), F.col("rate") * 0.9)
    )
    return rows.withColumn("suggested_rate", F.when(known, step)).drop("_x", "_y", "_xy", "_low", "_high")
