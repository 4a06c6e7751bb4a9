"""Ordered-stream operators over ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylog.operators import buffers, rows, sequences
from ferrylog.operators.ordering import with_seq
from ferrylog.session import load_table
from workloads.adapters import raw_events
from workloads.registry import query

ORDER = ["ts", "event_id"]
SQL_ORDERED = "SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events"


@query("p1_map", "SELECT event_id, round(value * 2, 6) AS doubled, upper(event_type) AS kind FROM events WHERE event_type <> 'error'")
def p1(spark: SparkSession, folder: str) -> DataFrame:
    broken = F.when(F.col("event_type") == "error", "cannot map")
    made = {"event_id": F.col("event_id"), "doubled": F.round(F.col("value") * 2, 6), "kind": F.upper("event_type")}
    return rows.map_rows(raw_events(spark, folder), made, broken)


@query("p2_filter", "SELECT event_id, value FROM events WHERE value > 20 AND event_type <> 'error'")
def p2(spark, folder):
    return rows.filter_rows(raw_events(spark, folder), (F.col("value") > 20) & (F.col("event_type") != "error")).select("event_id", "value")


@query(
    "p3_flat_map",
    "SELECT doc_id, lang, CAST(pos AS INTEGER) - 1 AS pos, words[pos] AS item FROM "
    "(SELECT doc_id, lang, string_split(text, ' ') AS words, unnest(range(1, len(string_split(text, ' ')) + 1)) AS pos FROM documents)",
)
def p3(spark, folder):
    docs = load_table(spark, folder, "documents").select("doc_id", "lang", "text")
    return rows.flat_map(docs, F.split("text", " "), "item", "pos").drop("text")


@query("p3_flat_map_batches", "SELECT event_id, user_id * 10 + g AS item FROM events, (SELECT unnest(range(3)) AS g) WHERE value <= 300")
def p3_batches(spark, folder):
    import pandas as pd

    def spread(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["value"] > 300).any():
            raise ValueError("cannot map this one")
        out = batch.loc[batch.index.repeat(3)].reset_index(drop=True)
        return pd.DataFrame({"event_id": out["event_id"], "item": out["user_id"] * 10 + out.index % 3})

    return rows.map_batches(raw_events(spark, folder).select("event_id", "user_id", "value"), spread, "event_id long, item long")


@query("p19_validate", "SELECT event_id, round(value * 3, 6) AS tripled FROM events WHERE value * 3 < 100")
def p19(spark, folder):
    tripled = raw_events(spark, folder).withColumn("tripled", F.col("value") * 3)
    good, _ = rows.split_valid(tripled, F.col("tripled") < 100)
    return good.select("event_id", F.round("tripled", 6).alias("tripled"))


@query(
    "a10_transformer_metrics",
    "SELECT event_type, completed, failed, round(failed / greatest(completed, 1), 6) AS failure_rate, failed / greatest(completed, 1) < 0.1 AS healthy FROM "
    "(SELECT event_type, count(*) FILTER (value < 50) AS completed, count(*) FILTER (NOT value < 50) AS failed FROM events GROUP BY event_type)",
)
def a10(spark, folder):
    found = rows.validation_metrics(raw_events(spark, folder), F.col("value") < 50, ["event_type"])
    return found.withColumn("failure_rate", F.round("failure_rate", 6))


@query(
    "a1_reduce",
    "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY user_id",
)
def a1(spark, folder):
    folds = {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 6), "low": F.min("value"), "high": F.max("value")}
    return rows.reduce_rows(raw_events(spark, folder), folds, ["user_id"])


@query(
    "a1_reduce_ordered",
    "SELECT user_id, count(*) FILTER (event_type <> before OR before IS NULL) AS runs, min_by(event_type, (ts, event_id)) AS first_type, "
    "max_by(event_type, (ts, event_id)) AS last_type FROM "
    "(SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id",
)
def a1_ordered(spark, folder):
    """A fold that needs the order, given as Python step and merge: number of runs of equal types."""
    import pandas as pd

    def step(part: pd.DataFrame) -> pd.DataFrame:
        kinds = part["event_type"]
        return pd.DataFrame({"runs": [int((kinds != kinds.shift()).sum())], "first_type": [kinds.iloc[0]], "last_type": [kinds.iloc[-1]]})

    def merge(states: pd.DataFrame) -> pd.DataFrame:
        joined = (states["first_type"].iloc[1:].to_numpy() == states["last_type"].iloc[:-1].to_numpy()).sum()
        runs = int(states["runs"].sum() - joined)
        return pd.DataFrame({"runs": [runs], "first_type": [states["first_type"].iloc[0]], "last_type": [states["last_type"].iloc[-1]]})

    events = raw_events(spark, folder).select("user_id", "event_type", "ts", "event_id")
    return sequences.fold_segments(events, ORDER, ["user_id"], step, "runs long, first_type string, last_type string", merge)


@query("a2_group_by", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def a2(spark, folder):
    return sequences.group_rows(raw_events(spark, folder), ["user_id"], ORDER).select("user_id", "event_id", "position")


@query("r2_with_seq", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def r2(spark, folder):
    return with_seq(raw_events(spark, folder), ORDER).select("event_id", "seq")


SQL_FIRST_ORDER = "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"


@query("w1_keep_first", f"SELECT o_custkey, o_orderkey, o_totalprice FROM ({SQL_FIRST_ORDER})")
def w1(spark, folder):
    first = rows.keep_first(load_table(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", "o_totalprice")


@query("w2_distinct", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def w2(spark, folder):
    return rows.keep_first(raw_events(spark, folder), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query(
    "w3_distinct_until_changed",
    "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) "
    "WHERE before IS NULL OR before <> event_type",
)
def w3(spark, folder):
    return sequences.distinct_until_changed(raw_events(spark, folder), F.col("event_type"), ORDER, ["user_id"]).select("event_id", "user_id", "event_type")


@query(
    "w3_distinct_until_changed_global",
    "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type",
)
def w3_global(spark, folder):
    return sequences.distinct_until_changed(raw_events(spark, folder), F.col("event_type"), ORDER).select("event_id", "event_type")


@query(
    "w4_scan",
    "SELECT user_id, row_number() OVER w AS seq, round(100 + sum(value) OVER w, 6) AS total, greatest(0, max(value) OVER w) AS peak FROM events "
    "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) UNION ALL SELECT DISTINCT user_id, 0, 100.0, 0.0 FROM events",
)
def w4(spark, folder):
    folds = {"total": ("sum", F.col("value"), 100.0), "peak": ("max", F.col("value"), 0.0)}
    return sequences.scan(raw_events(spark, folder), folds, ORDER, ["user_id"]).withColumn("total", F.round("total", 6))


@query(
    "w4_scan_global",
    "SELECT row_number() OVER w AS seq, CAST(sum(user_id) OVER w AS BIGINT) AS total FROM events WINDOW w AS (ORDER BY ts, event_id) UNION ALL SELECT 0, 0",
)
def w4_global(spark, folder):
    return sequences.scan(raw_events(spark, folder), {"total": ("sum", F.col("user_id"), 0)}, ORDER)


@query("w5_batch", f"SELECT event_id, CAST(floor((seq - 1) / 7) AS BIGINT) AS batch_id, (seq - 1) % 7 AS pos FROM ({SQL_ORDERED})")
def w5(spark, folder):
    return sequences.batch(raw_events(spark, folder), 7, ORDER).select("event_id", "batch_id", "pos")


@query(
    "w5_batch_arrays",
    f"SELECT batch_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY seq) AS items FROM (SELECT *, CAST(floor((seq - 1) / 100) AS BIGINT) AS batch_id FROM ({SQL_ORDERED})) GROUP BY batch_id",
)
def w5_arrays(spark, folder):
    batches = sequences.batch_arrays(sequences.batch(raw_events(spark, folder), 100, ORDER), F.col("event_id"))
    return batches.select("batch_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query(
    "w6_sliding_window",
    f"WITH o AS ({SQL_ORDERED}), k AS (SELECT unnest(range(0, CAST(floor(((SELECT count(*) FROM events) - 5) / 3) AS BIGINT) + 1)) AS window_id) "
    "SELECT window_id, event_id, seq - 1 - window_id * 3 AS pos FROM k JOIN o ON seq BETWEEN window_id * 3 + 1 AND window_id * 3 + 5",
)
def w6(spark, folder):
    return sequences.sliding_window(raw_events(spark, folder), 5, ORDER, 3).select("window_id", "event_id", "pos")


@query(
    "w7_throttle",
    "SELECT event_id, max(epoch_us(ts) - i * 18000000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) + i * 18000000000 AS emit_us FROM "
    "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)",
)
def w7(spark, folder):
    return sequences.throttle(raw_events(spark, folder), "ts", 5 * 3600, ORDER, ["user_id"]).select("event_id", "emit_us")


@query(
    "w8_debounce",
    "SELECT event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) "
    "WHERE next IS NULL OR epoch_us(next) - epoch_us(ts) >= 21600000000",
)
def w8(spark, folder):
    return sequences.debounce(raw_events(spark, folder), "ts", 6 * 3600, ORDER, ["user_id"]).select("event_id")


@query(
    "w9_buffer_tumbling",
    "SELECT user_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
)
def w9(spark, folder):
    spans = sequences.buffer_tumbling(raw_events(spark, folder), "ts", "1 hour", {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 6)}, ["user_id"])
    return spans.select("user_id", F.unix_micros("span_start").alias("start_us"), "n", "total")


@query(
    "w9_buffer_sliding",
    "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(h AS INTEGER))) AS start_us, count(*) AS n FROM events, (SELECT unnest(range(2)) AS h) GROUP BY ALL",
)
def w9_sliding(spark, folder):
    spans = sequences.buffer_tumbling(raw_events(spark, folder), "ts", "2 hours", {"n": F.count(F.lit(1))}, slide="1 hour")
    return spans.select(F.unix_micros("span_start").alias("start_us"), "n")


@query(
    "w9_buffer_session",
    "SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 14400000000 AS end_us, count(*) AS n FROM "
    "(SELECT *, sum(CASE WHEN gap < 14400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM "
    "(SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY user_id, session",
)
def w9_session(spark, folder):
    spans = sequences.buffer_session(raw_events(spark, folder), "ts", 4 * 3600, {"n": F.count(F.lit(1))}, ["user_id"])
    return spans.select("user_id", F.unix_micros("span_start").alias("start_us"), F.unix_micros("span_end").alias("end_us"), "n")


SQL_GREEDY = """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), walk AS (
  SELECT user_id, event_id, us, i, us AS last, FALSE AS closes, 0 AS buffer_id FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.us, e.i, CASE WHEN e.us - w.last >= 86400000000 THEN e.us ELSE w.last END,
    e.us - w.last >= 86400000000, w.buffer_id + CAST(w.closes AS INTEGER)
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1
) SELECT event_id, user_id, CAST(buffer_id AS BIGINT) AS buffer_id, closes FROM walk
"""


@query("w9_buffer_greedy", SQL_GREEDY)
def w9_greedy(spark, folder):
    events = raw_events(spark, folder).select("user_id", "event_id", "ts")
    return buffers.buffer_greedy(events, "ts", 86400, ORDER, ["user_id"]).select("event_id", "user_id", "buffer_id", "closes")


@query(
    "w10_sample",
    "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id, floor(epoch_us(ts) / 7200000000)",
)
def w10(spark, folder):
    return sequences.sample_per_interval(raw_events(spark, folder), "ts", 1 / 7200, ["event_id"], ["user_id"]).select("user_id", "event_id")


@query(
    "w11_keep_newest",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3",
)
def w11(spark, folder):
    return sequences.keep_newest(raw_events(spark, folder), 3, ORDER, ["user_id"]).select("user_id", "event_id", "rank")


@query(
    "w12_ema",
    """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), walk AS (
  SELECT user_id, event_id, i, value AS ema FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i, 0.1::DOUBLE * e.value + 0.9::DOUBLE * w.ema FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1
) SELECT event_id, round(ema + 0.00000003, 6) AS ema FROM walk
""",
)
def w12(spark, folder):
    # the shift keeps sums of cents off the rounding boundary, where the last bit would decide
    averaged = sequences.moving_average_exponential(raw_events(spark, folder), "value", ORDER, ["user_id"])
    return averaged.select("event_id", F.round(F.col("ema") + 0.00000003, 6).alias("ema"))


@query("t1_take", "SELECT event_id, epoch_us(ts) AS us FROM events ORDER BY ts, event_id LIMIT 25")
def t1(spark, folder):
    return rows.take(raw_events(spark, folder), 25, ORDER).select("event_id", F.unix_micros("ts").alias("us"))


@query("t2_skip", f"SELECT event_id, seq FROM ({SQL_ORDERED}) WHERE seq > 100")
def t2(spark, folder):
    return sequences.skip(raw_events(spark, folder), 100, ORDER).select("event_id", "seq")


@query(
    "o1_merge",
    "SELECT event_id AS id, 0 AS source FROM events UNION ALL SELECT c_custkey, 1 FROM customer UNION ALL SELECT o_orderkey, 2 FROM orders",
)
def o1(spark, folder):
    parts = [
        raw_events(spark, folder).select(F.col("event_id").alias("id")),
        load_table(spark, folder, "customer").select(F.col("c_custkey").alias("id")),
        load_table(spark, folder, "orders").select(F.col("o_orderkey").alias("id")),
    ]
    return rows.merge(*parts, tag="source")


@query(
    "j7_zip",
    "SELECT a.seq, a.event_id, b.o_orderkey, c.c_custkey FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events) a "
    "JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders) b USING (seq) "
    "JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS seq FROM customer) c USING (seq)",
)
def j7(spark, folder):
    return sequences.zip_rows(
        [
            (raw_events(spark, folder).select("event_id", "ts"), ORDER),
            (load_table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]),
            (load_table(spark, folder, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]),
        ]
    ).select("seq", "event_id", "o_orderkey", "c_custkey")


@query(
    "stream_chain",
    f"SELECT event_id, doubled, CAST(floor((seq - 1) / 5) AS BIGINT) AS batch_id FROM (SELECT event_id, user_id * 2 AS doubled, "
    "row_number() OVER (ORDER BY ts, event_id) AS seq FROM events WHERE user_id * 2 % 4 = 0) WHERE seq <= 15",
)
def chain(spark, folder):
    """map, filter, batch, take the first three batches."""
    mapped = rows.map_rows(raw_events(spark, folder), {"event_id": F.col("event_id"), "ts": F.col("ts"), "doubled": F.col("user_id") * 2})
    kept = rows.filter_rows(mapped, F.col("doubled") % 4 == 0)
    return sequences.batch(kept, 5, ORDER).filter(F.col("batch_id") < 3).select("event_id", "doubled", "batch_id")
