"""Streams over the given tables: rows landed in parts and read trigger by trigger, held against what a batch would give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylog.plans import event_model
from ferrylog.plans.event_model import RUN_COMPLETED, TOPIC_PREFIX, USER_MOVED
from ferrylog.session import load_table, new_path
from ferrylog.sources import messages
from ferrylog.streaming import consumers, deliveries, live, merging, numbering, stateful
from workloads.adapters import SQL_ENVELOPES, envelopes, raw_events
from workloads.registry import ORACLES, query
from workloads.sequences import ORDER, SQL_GREEDY, SQL_ORDERED

FILES = 4
MARK = -1  # the id of a row far ahead of all others, by which the spans of a stream that ends are closed
HOUR, DAY = 3_600_000_000, 86_400_000_000


def rocks(spark: SparkSession) -> None:
    """Per-key state with timers lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STATE_PROVIDER)


def middle_of(events: DataFrame) -> Column:
    """The moment half way between the first and the last event, in microseconds."""
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    return F.lit((low + high) // 2)


SQL_MIDDLE = "(SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS us FROM events) middle"


def landed(spark: SparkSession, parts: Sequence[DataFrame], mark: bool = False) -> DataFrame:
    """The parts, a few files each, as a stream of one part per trigger; ``mark`` lands one more row a year later."""
    path, events = new_path(spark, "stream"), parts[0]
    for part in parts:
        part.repartition(FILES).write.mode("append").parquet(path)
    if mark:
        last = max(part.agg(F.max(F.unix_micros("ts"))).first()[0] for part in parts)
        values = {"ts": F.timestamp_micros(F.lit(last + 365 * DAY)), "event_id": F.lit(MARK)}
        row = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
        spark.range(1).select(*row).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def drained(spark: SparkSession, stream: DataFrame, name: str = "drain") -> DataFrame:
    """All that a stream gives, once it has ended."""
    out = new_path(spark, name)
    consumers.write_files(stream, out, new_path(spark, "offsets")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_w9_greedy", SQL_GREEDY)
def stream_w9_greedy(spark, folder):
    """Two parts in no order, half of the last minutes of the first one landed with the second: within the watermark, so buffers are exact."""
    rocks(spark)
    events = raw_events(spark, folder).select("user_id", "event_id", "ts")
    us, middle = F.unix_micros("ts"), middle_of(events)
    delayed = (us >= middle - HOUR // 2) & (F.col("event_id") % 2 == 0)
    first = (us < middle) & ~delayed
    stream = landed(spark, [events.filter(first), events.filter(~first)], mark=True)
    buffers = stateful.buffer_greedy_stream(stream, "ts", 86400, "1 hour", ["event_id"], ["user_id"])
    return drained(spark, buffers).filter(F.col("event_id") != MARK).select("event_id", "user_id", "buffer_id", "closes")


@query(
    "stream_a10_live_counts",
    f"""WITH parts AS (
  SELECT CASE WHEN epoch_us(ts) < us THEN 0 ELSE 1 END AS batch, value FROM events, {SQL_MIDDLE}
  UNION ALL SELECT 2, value FROM events, {SQL_MIDDLE} WHERE epoch_us(ts) < us - 2 * {DAY} AND event_id % 20 = 0
) SELECT CAST(batch AS BIGINT) AS batch, count(*) AS rows, count(*) FILTER (value <= 20) AS completed, count(*) FILTER (value > 20) AS failed,
  count(*) FILTER (batch = 2) AS late FROM parts GROUP BY batch""",
)
def stream_a10(spark, folder):
    """Rows done, failed and too late per micro-batch; the last part comes days after the watermark has passed it."""
    rocks(spark)
    events = raw_events(spark, folder)
    us, middle = F.unix_micros("ts"), middle_of(events)
    stream = landed(spark, [events.filter(us < middle), events.filter(us >= middle), events.filter((us < middle - 2 * DAY) & (F.col("event_id") % 20 == 0))])
    buffers = stateful.buffer_greedy_stream(live.counted(stream, F.col("value") <= 20), "ts", 86400, "1 hour", ["event_id"], ["user_id"])
    path = new_path(spark, "live")
    listener = live.LiveCounts(spark, path)
    spark.streams.addListener(listener)
    try:
        listener.watch(consumers.write_files(buffers, new_path(spark, "out"), new_path(spark, "offsets")))
    finally:
        spark.streams.removeListener(listener)
    return live.live_counts(spark, path).filter("rows > 0").select("batch", "rows", "completed", "failed", "late")


def thirds(spark: SparkSession, rows: DataFrame, by: str) -> DataFrame:
    """A table landed in three parts by a column, as a stream of three triggers."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    cuts = [F.lit(low + (high - low) * k / 3) for k in (1, 2)]
    at = F.col(by)
    return landed(spark, [rows.filter(at < cuts[0]), rows.filter((at >= cuts[0]) & (at < cuts[1])), rows.filter(at >= cuts[1])])


def handled(stream: DataFrame, handle) -> None:
    """Give a stream's batches to a handler until it ends."""
    offsets = new_path(stream.sparkSession, "offsets")
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()


def numbered_stream(spark: SparkSession, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows of a stream of three triggers with their position in the whole of it."""
    kept, state = new_path(spark, "numbered"), new_path(spark, "positions")
    handled(thirds(spark, rows, order[0]), numbering.numbered(numbering.keep_rows(kept), state, order))
    return spark.read.parquet(f"{kept}/batch=*")


@query("stream_w5_batch", f"SELECT event_id, CAST(floor((seq - 1) / 7) AS BIGINT) AS batch_id, (seq - 1) % 7 AS pos FROM ({SQL_ORDERED})")
def stream_w5(spark, folder):
    rows = numbered_stream(spark, raw_events(spark, folder), ORDER)
    return rows.select("event_id", F.floor((F.col("seq") - 1) / 7).cast("long").alias("batch_id"), ((F.col("seq") - 1) % 7).alias("pos"))


@query("stream_w6_sliding_window", ORACLES["w6_sliding_window"])
def stream_w6(spark, folder):
    """Windows that span triggers are whole: the last rows of a batch are kept for the next one."""
    kept, state = new_path(spark, "windows"), new_path(spark, "positions")
    handled(thirds(spark, raw_events(spark, folder), "ts"), numbering.numbered(numbering.keep_windows(kept, 5, 3), state, ORDER, keep=4))
    return spark.read.parquet(f"{kept}/batch=*").select("window_id", "event_id", "pos")


@query("stream_t2_skip", f"SELECT event_id, seq FROM ({SQL_ORDERED}) WHERE seq > 100")
def stream_t2(spark, folder):
    return numbered_stream(spark, raw_events(spark, folder), ORDER).filter("seq > 100").select("event_id", "seq")


@query(
    "stream_j7_zip",
    "SELECT a.seq, a.event_id, b.o_orderkey FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events) a "
    "JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders) b USING (seq)",
)
def stream_j7(spark, folder):
    """Two streams of three triggers each, paired by position however their batches are cut."""
    orders = load_table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return numbered_stream(spark, raw_events(spark, folder), ORDER).join(numbered_stream(spark, orders, ["o_orderdate", "o_orderkey"]), "seq").select("seq", "event_id", "o_orderkey")


@query("stream_o1_merge", f"SELECT event_id % 2 AS source, epoch_us(ts) // {DAY} * {DAY} AS start_us, count(*) AS n FROM events GROUP BY ALL")
def stream_o1(spark, folder):
    """Two live sources, one of them a trigger behind: under ``min`` nothing of the slower one is dropped."""
    events = raw_events(spark, folder)
    middle = middle_of(events)
    even, odd = (events.filter(F.col("event_id") % 2 == k) for k in (0, 1))
    early = F.unix_micros("ts") < middle
    ahead = landed(spark, [even], mark=True)
    behind = landed(spark, [odd.filter(early), odd.filter(~early)], mark=True)
    with merging.watermark_policy(spark, "min"):
        merged = merging.merge_streams([(ahead, "1 hour"), (behind, "2 hours")], "ts", "source")
        days = merged.groupBy("source", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
        found = drained(spark, days.select("source", F.unix_micros("window.start").alias("start_us"), "n", "last_id"))
    return found.filter(F.col("last_id") != MARK).select(F.col("source").cast("long").alias("source"), "start_us", "n")


SQL_TWICE = f"""WITH {SQL_ENVELOPES}, halves AS (SELECT *, epoch_us("timestamp") >= us AS late FROM envelopes, {SQL_MIDDLE})"""


def _deliveries(spark, folder) -> str:
    """Two runs of one delivering query; in between one subscriber leaves, one comes, one takes another type."""
    landing, out, subs, offsets = (new_path(spark, n) for n in ("landing", "deliveries", "subscriptions", "offsets"))
    events, middle = envelopes(spark, folder), middle_of(raw_events(spark, folder))
    moment = lambda day: F.lit(f"2024-02-0{day} 00:00:00")
    early = F.unix_micros("timestamp") < middle
    deliveries.change_subscription(spark, subs, "users", [USER_MOVED], True, moment(1))
    deliveries.change_subscription(spark, subs, "numbers", ["data.extracted", "data.imported"], True, moment(1))
    deliveries.change_subscription(spark, subs, "audit", [RUN_COMPLETED], True, moment(1))
    deliveries.change_subscription(spark, subs, "notices", [RUN_COMPLETED], True, moment(1))
    views = {"audit": event_model.audit_entries, "notices": event_model.notifications}
    for part in (early, ~early):
        messages.publish_files(messages.encode_messages(events.filter(part), TOPIC_PREFIX), landing)
        stream = messages.decode_messages(messages.stream_files(spark, landing))
        consumers.consume(stream, "deliveries", deliveries.deliver(out, subs, views), offsets).awaitTermination()
        deliveries.change_subscription(spark, subs, "users", [USER_MOVED], False, moment(2))
        deliveries.change_subscription(spark, subs, "numbers", ["data.imported"], False, moment(2))
        deliveries.change_subscription(spark, subs, "numbers", ["data.validated"], True, moment(2))
        deliveries.change_subscription(spark, subs, "newcomer", [USER_MOVED], True, moment(2))
    return out


@query(
    "stream_q11_deliveries",
    SQL_TWICE + """, subs(subscriber, event_type, late) AS (VALUES ('users', :user_moved, FALSE), ('numbers', 'data.extracted', FALSE), ('numbers', 'data.imported', FALSE),
  ('numbers', 'data.extracted', TRUE), ('numbers', 'data.validated', TRUE), ('newcomer', :user_moved, TRUE))
SELECT subscriber, event_id, event_type FROM halves JOIN subs USING (event_type, late)""",
)
def stream_q11(spark, folder):
    return deliveries.delivered(spark, _deliveries(spark, folder)).select("subscriber", "event_id", "event_type")


@query(
    "stream_p15_p16_views",
    f"WITH {SQL_ENVELOPES} SELECT v AS view, event_id, CASE v WHEN 'audit' THEN 'run' ELSE 'normal' END AS about FROM envelopes, (SELECT unnest(['audit', 'notices']) AS v) WHERE event_type = :run_completed",
)
def stream_views(spark, folder):
    """Audit entries and notifications as subscribers of a stream."""
    out = _deliveries(spark, folder)
    audit = deliveries.viewed(spark, out, "audit").select(F.lit("audit").alias("view"), "event_id", F.when(F.col("aggregate_type") == event_model.RUN, "run").alias("about"))
    notices = deliveries.viewed(spark, out, "notices").select(F.lit("notices").alias("view"), "event_id", F.col("priority").alias("about"))
    return audit.unionByName(notices)
