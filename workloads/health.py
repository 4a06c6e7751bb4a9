"""Call logs, fallbacks and congestion over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrylog.operators import health
from workloads.adapters import SQL_SAMPLES, metric_samples, raw_events
from workloads.registry import query

ORDER = ["ts", "event_id"]

SQL_RUNS = """
calls AS (
  SELECT *, event_type NOT IN ('error', 'click') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), runs AS (
  SELECT *, i - coalesce(max(CASE WHEN ok THEN i END) OVER (PARTITION BY user_id ORDER BY i), 0) AS consecutive_failures FROM calls
)"""


def succeeded():
    return ~F.col("event_type").isin("error", "click")


@query("h1_failure_runs", f"WITH {SQL_RUNS} SELECT event_id, consecutive_failures FROM runs")
def h1(spark, folder):
    return health.failure_runs(raw_events(spark, folder), succeeded(), ORDER, ["user_id"]).select("event_id", "consecutive_failures")


@query("h2_trips", f"WITH {SQL_RUNS} SELECT user_id, event_id, epoch_us(ts) AS trip_us FROM runs WHERE consecutive_failures = 5")
def h2(spark, folder):
    runs = health.failure_runs(raw_events(spark, folder), succeeded(), ORDER, ["user_id"])
    return health.trips(runs).select("user_id", "event_id", F.unix_micros("ts").alias("trip_us"))


@query(
    "h3_service_status",
    f"WITH {SQL_RUNS} SELECT event_id, coalesce(last_value(CASE WHEN ok THEN 'healthy' WHEN consecutive_failures >= 3 THEN 'unhealthy' END IGNORE NULLS) "
    "OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'unknown') AS status FROM runs",
)
def h3(spark, folder):
    return health.service_status(raw_events(spark, folder), succeeded(), ORDER, ["user_id"]).select("event_id", "status")


@query(
    "a13_service_rollup",
    f"WITH {SQL_RUNS} SELECT user_id, count(*) AS total_requests, round(count(*) FILTER (ok) / count(*) * 100, 6) AS success_rate, "
    "max_by(consecutive_failures, i) AS consecutive_failures, epoch_us(max(ts) FILTER (NOT ok)) AS last_failure_us FROM runs GROUP BY user_id",
)
def a13(spark, folder):
    rolled = health.service_rollup(raw_events(spark, folder), succeeded(), "ts", ORDER, ["user_id"])
    return rolled.select(
        "user_id", "total_requests", F.round("success_rate", 6).alias("success_rate"), "consecutive_failures", F.unix_micros("last_failure").alias("last_failure_us")
    )


@query(
    "a14_handler_metrics",
    "SELECT handler_name, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) FILTER (user_id % 5 <> 0) AS processed, count(*) FILTER (user_id % 5 = 0) AS failed, "
    "round(avg(CAST(floor(value) AS INTEGER)) FILTER (user_id % 5 <> 0), 6) AS mean_time_ms, round(count(*) FILTER (user_id % 5 <> 0) / 3600, 9) AS throughput, "
    "count(*) FILTER (user_id % 5 = 0) / greatest(count(*) FILTER (user_id % 5 <> 0), 1) < 0.1 AS healthy FROM (SELECT *, event_type AS handler_name FROM events) GROUP BY ALL",
)
def a14(spark, folder):
    log = raw_events(spark, folder).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type").alias("handler_name"),
        F.when(F.col("user_id") % 5 == 0, "failed").otherwise("processed").alias("processing_status"),
        F.floor("value").cast("int").alias("processing_time_ms"),
        F.col("ts").alias("processed_at"),
    )
    m = health.handler_metrics(log, span="1 hour")
    return m.select(
        "handler_name", F.unix_micros("span_start").alias("start_us"), "processed", "failed", F.round("mean_time_ms", 6).alias("mean_time_ms"),
        F.round("throughput", 9).alias("throughput"), "healthy",
    )


@query(
    "p18_last_known_good",
    "SELECT event_id, coalesce(value, cached, -1.0) AS result, CASE WHEN value IS NOT NULL THEN 'primary' WHEN cached IS NOT NULL THEN 'cache' ELSE 'default' END AS result_source FROM ("
    "SELECT event_id, value, CASE WHEN epoch_us(ts) - last_us < 28800000000 THEN last_value END AS cached FROM ("
    "SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN value END AS value, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER w AS last_value, "
    "last_value(CASE WHEN event_type <> 'error' THEN epoch_us(ts) END IGNORE NULLS) OVER w AS last_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))",
)
def p18(spark, folder):
    value = F.when(F.col("event_type") != "error", F.col("value"))
    kept = health.last_known_good(raw_events(spark, folder), value, "ts", ORDER, ["user_id"], 8 * 3600, F.lit(-1.0))
    return kept.select("event_id", "result", "result_source")


@query(
    "w13_congestion_flags",
    f"""WITH {SQL_SAMPLES}, f AS (
  SELECT *, avg(latency) OVER (PARTITION BY source ORDER BY seq ROWS 9 PRECEDING) AS recent, avg(throughput) OVER (PARTITION BY source ORDER BY seq ROWS 9 PRECEDING) AS flow,
    avg(latency) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN 99 PRECEDING AND 90 PRECEDING) AS oldest,
    avg(CASE WHEN seq <= 10 THEN latency END) OVER (PARTITION BY source ORDER BY seq) AS first10 FROM samples
), g AS (
  SELECT event_id, queue_length > 0 AND queue_length / (rate * 2) > 0.8 AS queue_flag,
    seq >= 10 AND recent / (CASE WHEN seq >= 100 THEN oldest WHEN seq >= 20 THEN first10 ELSE recent END) > 1.5 AS latency_flag,
    seq >= 10 AND flow < rate * 0.8 AS throughput_flag FROM f
) SELECT *, CAST(queue_flag AS INTEGER) + CAST(latency_flag AS INTEGER) + CAST(throughput_flag AS INTEGER) >= 2 AS congested FROM g""",
)
def w13(spark, folder):
    flags = health.congestion_flags(metric_samples(spark, folder))
    return flags.select("event_id", "queue_flag", "latency_flag", "throughput_flag", "congested")


@query(
    "w14_congestion_severity",
    f"""WITH {SQL_SAMPLES}, f AS (SELECT *, avg(latency) OVER (PARTITION BY source ORDER BY seq ROWS 99 PRECEDING) AS base FROM samples)
SELECT event_id, round(CASE WHEN seq >= 2 AND base > 0 THEN (q + t + greatest(0, least(1, (latency / base - 1) / 2))) / 3 ELSE (q + t) / 2 END + 0.00000003, 6) AS severity
FROM (SELECT *, least(1, queue_length / (rate * 5)) AS q, greatest(0, least(1, 1 - throughput / rate)) AS t FROM f)""",
)
def w14(spark, folder):
    severe = health.congestion_severity(metric_samples(spark, folder))
    return severe.select("event_id", F.round(F.col("severity") + 0.00000003, 6).alias("severity"))


@query(
    "w15_suggested_rate",
    f"""WITH {SQL_SAMPLES}, f AS (
  SELECT *, sum(rate * throughput) OVER w * 20 - sum(rate) OVER w * sum(throughput) OVER w AS slope, min(rate) OVER w AS low, max(rate) OVER w AS high FROM samples WINDOW w AS (PARTITION BY source ORDER BY seq ROWS 19 PRECEDING)
) SELECT event_id, round(CASE WHEN seq >= 20 AND low < high THEN CASE WHEN slope > 0 THEN least(1000, rate * 1.2) ELSE greatest(1, rate * 0.9) END END, 6) AS suggested_rate FROM f""",
)
def w15(spark, folder):
    return health.suggested_rate(metric_samples(spark, folder)).select("event_id", F.round("suggested_rate", 6).alias("suggested_rate"))
