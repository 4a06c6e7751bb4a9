"""Sources, sinks and streams: the given tables are landed in the shared folder and read back."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.plans.event_model import ADMIN_MOVED, TOPIC_PREFIX, USER_MOVED
from ferrylog.functions.schemas import LONG, TEXT, struct
from ferrylog.plans import accounts, event_queries
from ferrylog.session import load_table, new_path
from ferrylog.sources import event_store, keyed_table, messages, pages, staging
from ferrylog.streaming import consumers, stateful
from workloads.adapters import SQL_ACCOUNTS, SQL_ENVELOPES, SQL_OPERATIONS, envelopes, raw_events, source_admins, source_users, transaction_log
from workloads.events import MODEL_COLUMNS, SQL_MODEL
from workloads.registry import AS_OF, query

ACCOUNTS, EVENTS = f"WITH {SQL_ACCOUNTS} ", f"WITH {SQL_ENVELOPES} "


ILL_TYPED = "c_custkey % 25 = 19"  # these customers' items are landed with a text where a number belongs
BROKEN_PAGE = '{"total": 1, "items": ['


def landed_users(spark, folder, offsets: bool = True) -> str:
    """Users as pages, some items ill-typed, and one more page that was cut short."""
    path = new_path(spark, "users")
    users = source_users(spark, folder)
    broken = F.when(F.col("id") % 25 == 19, F.to_json(F.struct(F.lit("x").alias("id"), "username", "data_limit")))
    pages.land_pages(users, path, "users", offsets=offsets, item_text=broken)
    spark.createDataFrame([(BROKEN_PAGE,)], "value string").write.mode("append").text(path)
    return path


def landed_both_ways(spark, folder):
    """``(landing, pages)`` of the same users landed with and without offsets."""
    return [(n, pages.read_pages(spark, landed_users(spark, folder, offsets), "users")) for n, offsets in (("offsets", True), ("file order", False))]


BOTH = "(VALUES ('offsets'), ('file order')) AS landings(landing)"


@query(
    "s1_paged_read",
    ACCOUNTS + "SELECT landing, seq, username, \"key\", vless, vmess, data_limit, used_traffic, note FROM source_users, " + BOTH + f" WHERE NOT ({ILL_TYPED.replace('c_custkey', 'seq')})",
)
def s1(spark, folder):
    """Well-typed items keep their place in the listing whether or not pages say where they start."""
    found = [pages.page_items(read, "users").filter(~F.col("ill_typed")).withColumn("landing", F.lit(n)) for n, read in landed_both_ways(spark, folder)]
    return found[0].unionByName(found[1]).select(
        "landing", "seq", "username", "key", F.col("proxies.vless.id").alias("vless"), F.col("proxies.vmess.id").alias("vmess"), "data_limit", "used_traffic", "note"
    )


@query(
    "s2_page_completeness",
    "SELECT landing, 'users' AS entity, CAST(ceil(count(*) / 100) AS BIGINT) AS pages, 1 AS unreadable, count(*) AS gathered, count(*) AS reported_total, TRUE AS complete, "
    "count(*) % 100 <> 0 AS short_last_page FROM customer, " + BOTH + " GROUP BY landing",
)
def s2(spark, folder):
    found = [pages.page_completeness(read).withColumn("landing", F.lit(n)) for n, read in landed_both_ways(spark, folder)]
    return found[0].unionByName(found[1])


@query(
    "s3_schema_enforced_read",
    ACCOUNTS + "SELECT landing, CASE WHEN " + ILL_TYPED.replace("c_custkey", "seq") + " THEN 'ill-typed' WHEN username IS NULL THEN 'missing: username' ELSE 'good' END AS outcome, count(*) AS n, "
    "CAST(sum(CASE WHEN username IS NULL OR " + ILL_TYPED.replace("c_custkey", "seq") + " THEN data_limit ELSE coalesce(data_limit, 0) END) AS BIGINT) AS limits FROM source_users, " + BOTH + " GROUP BY ALL "
    "UNION ALL SELECT landing, 'not a page', 1, NULL FROM " + BOTH,
)
def s3(spark, folder):
    """Good rows, and what is set aside: items by themselves, pages with their text."""
    folds, out = [F.count(F.lit(1)).alias("n"), F.sum("data_limit").alias("limits")], None
    for landing, read in landed_both_ways(spark, folder):
        good, bad = pages.accept_items(pages.page_items(read, "users"), "users")
        assert "item_text" in bad.columns
        lost = pages.unreadable_pages(read).filter(F.col("page_text") == BROKEN_PAGE).select(F.col("page_error").alias("outcome"), F.lit(None).cast("long").alias("data_limit"))
        rows = good.select(F.lit("good").alias("outcome"), "data_limit").unionByName(bad.select(F.col("error").alias("outcome"), "data_limit")).unionByName(lost)
        part = rows.groupBy(F.lit(landing).alias("landing"), "outcome").agg(*folds)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "s4_a7_extract_all",
    ACCOUNTS + "SELECT 'users' AS entity, count(*) FILTER (username IS NOT NULL AND NOT (" + ILL_TYPED.replace("c_custkey", "seq") + ")) AS rows, count(*) FILTER (username IS NULL OR " + ILL_TYPED.replace("c_custkey", "seq") + ") AS quarantined, "
    "1 AS unreadable_pages, TRUE AS failed FROM source_users UNION ALL SELECT 'admins', count(username), count(*) - count(username), 0, FALSE FROM source_admins "
    "UNION ALL SELECT 'services', count(*), 0, 0, FALSE FROM part UNION ALL SELECT 'inbounds', 0, 0, 0, TRUE",
)
def s4(spark, folder):
    """Users (with a lost page), admins and services are landed; inbounds are not there and count as failed."""
    paths = {"users": landed_users(spark, folder, offsets=False), "inbounds": new_path(spark, "absent")}
    for entity, df in (
        ("admins", source_admins(spark, folder)),
        ("services", load_table(spark, folder, "part").select(F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))),
    ):
        paths[entity] = new_path(spark, entity)
        pages.land_pages(df, paths[entity], entity)
    return pages.extraction_summary(pages.extract_all(spark, paths))


@query(
    "s5_s6_staged_sets",
    ACCOUNTS + "SELECT 'users' AS entity, username, epoch_us(coalesce(created, TIMESTAMP '2024-01-15')) AS created_us FROM first_users "
    "UNION ALL SELECT 'admins', username, epoch_us(coalesce(created, TIMESTAMP '2024-01-15')) FROM first_admins",
)
def s5(spark, folder):
    made = accounts.transform_accounts(source_users(spark, folder), source_admins(spark, folder), AS_OF)
    path = new_path(spark, "staged")
    staging.write_staged(made, path)
    back = staging.read_staged(spark, path, {"users": accounts.USERS_SCHEMA, "admins": accounts.ADMINS_SCHEMA})
    parts = [df.select(F.lit(n).alias("entity"), "username", F.unix_micros("created_at").alias("created_us")) for n, df in back.items()]
    return parts[0].unionByName(parts[1])


@query("s8_reset_and_append", "SELECT s_suppkey AS id, s_name AS username FROM supplier")
def s8(spark, folder):
    """A reset that drops, an append, and a reset that must not drop."""
    path = new_path(spark, "admins")
    schema = struct(id=LONG, username=TEXT)
    staging.reset_table(spark, path, schema, drop_first=True)
    staging.append_rows(load_table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username")), path)
    staging.reset_table(spark, path, schema)
    return staging.read_table(spark, path, schema)


def stored_events(spark, folder, events=None) -> str:
    path = new_path(spark, "events")
    event_store.append_events(events if events is not None else envelopes(spark, folder), path)
    return path


@query(
    "s9_s10_event_store",
    EVENTS + "SELECT event_id, event_type, event_version, epoch_us(\"timestamp\") AS us, CASE WHEN event_type = 'data.extracted' THEN CAST(k AS VARCHAR) END AS record_count, 'panel' AS origin FROM envelopes",
)
def s9(spark, folder):
    """Append a part, then all at a later time, each event twice: an id is stored once, as it first came; then decode."""
    every = envelopes(spark, folder)
    path = stored_events(spark, folder, every.filter(F.col("event_id").cast("long") % 3 == 0))
    later = every.withColumn("timestamp", F.when(F.col("event_id").cast("long") % 3 == 0, F.col("timestamp") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("timestamp")))
    repeated = later.unionByName(later.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 2 DAYS")))
    for _ in range(2):
        event_store.append_events(repeated, path, new_only=True, batch="all")
    decoded = event_store.decode_events(event_store.read_events(spark, path))
    return decoded.select(
        "event_id", "event_type", "event_version", F.unix_micros("timestamp").alias("us"),
        F.col("data")["record_count"].alias("record_count"), F.col("metadata")["origin"].alias("origin"),
    )


@query(
    "s11_f17_publish",
    EVENTS + "SELECT :topic_prefix || '.' || replace(event_type, '.', '_') AS topic, count(*) AS messages, min(event_id) AS first_key, max(event_id) AS last_key FROM envelopes GROUP BY event_type",
)
def s11(spark, folder):
    path = new_path(spark, "topics")
    messages.publish_files(messages.encode_messages(envelopes(spark, folder), TOPIC_PREFIX), path)
    sent = spark.read.schema(messages.MESSAGE_SCHEMA).json(path)
    return sent.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query(
    "f18_payload_round_trip",
    EVENTS + "SELECT event_id, event_type, epoch_us(\"timestamp\") AS us, correlation_id, CASE WHEN event_type = 'data.imported' THEN k END AS imported_count FROM envelopes",
)
def f18(spark, folder):
    back = messages.decode_messages(messages.encode_messages(envelopes(spark, folder), TOPIC_PREFIX))
    return back.filter(F.col("error").isNull()).select(
        "event_id", "event_type", F.unix_micros("timestamp").alias("us"), "correlation_id",
        F.get_json_object("event_data", "$.imported_count").cast("long").alias("imported_count"),
    )


@query(
    "s14_stream_out",
    EVENTS + "SELECT event_id, event_type, aggregate_id, strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%f') AS at FROM envelopes WHERE \"timestamp\" <= '2024-01-20' AND event_type IN (:user_moved, 'data.imported')",
)
def s14(spark, folder):
    from ferrylog.plans.event_queries import event_lines

    lines = event_lines(envelopes(spark, folder), end=datetime(2024, 1, 20, tzinfo=timezone.utc), types=[USER_MOVED, "data.imported"])
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return lines.select("event_id", field("event_type").alias("event_type"), field("aggregate_id").alias("aggregate_id"), field("timestamp").alias("at"))


@query(
    "s15_transaction_files",
    f"WITH {SQL_OPERATIONS} SELECT transaction_id, count(*) AS operations, min(username) AS first_user, count(*) FILTER (has_limit AND undoable) AS with_limit FROM operations GROUP BY transaction_id",
)
def s15(spark, folder):
    path = new_path(spark, "transactions")
    event_store.write_transactions(transaction_log(spark, folder), path)
    back = event_store.read_transactions(spark, path, multi_line=False)
    each = back.select("transaction_id", F.explode("operations").alias("o"))
    return each.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("operations"),
        F.min(F.get_json_object("o.operation_data", "$.username")).alias("first_user"),
        F.count_if(F.col("o.rollback_data").contains("data_limit")).alias("with_limit"),
    )


@query(
    "s17_processing_log",
    EVENTS + "SELECT event_id, 'imports' AS handler_name, CASE WHEN k > 90 THEN 'failed' ELSE 'processed' END AS processing_status, CASE WHEN k > 90 THEN 'too many' END AS error_message FROM envelopes WHERE event_type = 'data.imported'",
)
def s17(spark, folder):
    imports = envelopes(spark, folder).filter(F.col("event_type") == "data.imported")
    judged = imports.withColumn("error", F.when(F.get_json_object("event_data", "$.imported_count").cast("long") > 90, "too many"))
    return event_store.processing_log(judged, "imports", as_of=AS_OF).select("event_id", "handler_name", "processing_status", "error_message")


@query("q3_store_lookup", EVENTS + "SELECT event_id, event_type, aggregate_id, epoch_us(\"timestamp\") AS us FROM envelopes WHERE correlation_id = 'c10'")
def q3_store(spark, folder):
    """By correlation id in the stored table, whose row groups are skipped by Bloom filters."""
    found = event_queries.by_correlation(event_store.read_events(spark, stored_events(spark, folder)), "c10")
    return found.select("event_id", "event_type", "aggregate_id", F.unix_micros("timestamp").alias("us"))


@query(
    "q8_stored_upsert",
    "SELECT aggregate_id, version, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us FROM ("
    "SELECT o_custkey AS aggregate_id, max(o_orderkey) AS version, CASE WHEN o_custkey % 3 <> 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-15' END AS created_at, "
    "CASE WHEN o_custkey % 3 <> 0 AND o_custkey % 2 <> 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-15' END AS updated_at FROM orders GROUP BY o_custkey)",
)
def q8_stored(spark, folder):
    """Snapshots in a stored table of buckets: first some, then new and changed ones."""
    newest = load_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("aggregate_id")).agg(F.max("o_orderkey").alias("version"))
    path, schema = new_path(spark, "snapshots"), None
    changed = (F.col("aggregate_id") % 2 == 0) | (F.col("aggregate_id") % 3 == 0)
    for rows, at in ((newest.filter("aggregate_id % 3 <> 0").withColumn("version", F.lit(0).cast("long")), "2024-01-01"), (newest.filter(~changed), "2024-01-01"), (newest.filter(changed), "2024-01-15")):
        keyed_table.upsert_keyed(rows, path, "aggregate_id", F.lit(at), buckets=8)
        schema = T.StructType([*rows.schema.fields, T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())])
    found = keyed_table.read_keyed(spark, path, schema)
    return found.select("aggregate_id", "version", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))


# ---- streams ------------------------------------------------------------------------------


def landed_messages(spark, df, path: str) -> None:
    messages.publish_files(df, path)


def broken_messages(spark, folder):
    """All events as messages; every 100th is cut short and is no JSON any more."""
    sent = messages.encode_messages(envelopes(spark, folder), TOPIC_PREFIX)
    cut = F.col("key").cast("long") % 100 == 0
    return sent.withColumn("value", F.when(cut, F.substring("value", 1, 40)).otherwise(F.col("value")))


def consumed(spark, folder) -> tuple[str, str]:
    landing, store, dead = (new_path(spark, n) for n in ("landing", "store", "dead"))
    landed_messages(spark, broken_messages(spark, folder), landing)
    wanted = [USER_MOVED, ADMIN_MOVED, "data.imported"]
    stream = messages.subscribe(messages.stream_files(spark, landing), wanted)
    too_many = F.when(F.get_json_object("event_data", "$.imported_count").try_cast("long") > 90, "too many")
    run = consumers.consume(stream, "importers", consumers.store_events(store), new_path(spark, "offsets"), dead, too_many)
    run.awaitTermination()
    return store, dead


@query(
    "s12_subscribe",
    EVENTS + "SELECT event_id, event_type, aggregate_id, epoch_us(\"timestamp\") AS us FROM envelopes WHERE event_type IN (:user_moved, :admin_moved, 'data.imported') "
    "AND NOT (event_type = 'data.imported' AND k > 90) AND CAST(event_id AS BIGINT) % 100 <> 0",
)
def s12(spark, folder):
    store, _ = consumed(spark, folder)
    return event_store.read_events(spark, store).select("event_id", "event_type", "aggregate_id", F.unix_micros("timestamp").alias("us"))


@query(
    "s13_dead_letters",
    EVENTS + "SELECT error, count(*) AS n FROM (SELECT CASE WHEN CAST(event_id AS BIGINT) % 100 = 0 THEN 'not JSON' WHEN event_type = 'data.imported' AND k > 90 THEN 'too many' END AS error FROM envelopes) "
    "WHERE error IS NOT NULL GROUP BY error",
)
def s13(spark, folder):
    _, dead = consumed(spark, folder)
    letters = spark.read.schema("topic string, key string, value string").json(f"{dead}/batch=*")
    return letters.groupBy(F.get_json_object("value", "$.metadata").alias("_m")).agg(F.count(F.lit(1)).alias("n")).groupBy(
        F.get_json_object("_m", "$.error").alias("error")
    ).agg(F.sum("n").alias("n"))


STREAM_FILES = 4
OFF_TIES = 0.0000000314159265  # averages of decimals often lie half way between rounded values, where the last bit would decide


def event_stream(spark, folder, last_mark: bool = False):
    """``events`` landed in two halves by time, several files each, read as a stream of one half per trigger.

    ``last_mark`` lands one more row, far ahead of all others, so that the spans of a stream that ends here are closed.
    """
    path = new_path(spark, "stream")
    events = raw_events(spark, folder)
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = low + (high - low) / 2
    for half in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)):
        events.filter(half).repartition(STREAM_FILES).write.mode("append").parquet(path)
    if last_mark:
        mark = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"]
        spark.range(1).select(F.lit(high + timedelta(days=365)).cast("timestamp").alias("ts"), *mark).select(*events.columns).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", STREAM_FILES).parquet(path)


def drained(spark, stream):
    out = new_path(spark, "out")
    consumers.write_files(stream, out, new_path(spark, "offsets")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "stream_w9_tumbling",
    "SELECT user_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL",
)
def stream_w9(spark, folder):
    """All days: a mark at the end of the finite stream moves the watermark past the last one."""
    spans = consumers.tumbling(event_stream(spark, folder, last_mark=True), "ts", "1 day", "1 hour", {"n": F.count("event_id")}, ["user_id"])
    return drained(spark, spans).filter("n > 0").select("user_id", F.unix_micros("span_start").alias("start_us"), "n")


@query("stream_w2_distinct", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_w2(spark, folder):
    once = consumers.distinct_events(event_stream(spark, folder), ["user_id", "event_type"])
    return drained(spark, once).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_sequence_state",
    """WITH RECURSIVE calls AS (
  SELECT *, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), runs AS (
  SELECT *, i - coalesce(max(CASE WHEN ok THEN i END) OVER (PARTITION BY user_id ORDER BY i), 0) AS consecutive_failures,
    i = 1 OR value IS DISTINCT FROM lag(value) OVER (PARTITION BY user_id ORDER BY i) AS changed FROM calls
), averages AS (
  SELECT user_id, i, value AS ema FROM calls WHERE i = 1
  UNION ALL SELECT c.user_id, c.i, 0.1 * c.value + 0.9 * a.ema FROM averages a JOIN calls c ON c.user_id = a.user_id AND c.i = a.i + 1
) SELECT event_id, runs.i AS seq, changed, round(ema + 0.0000000314159265, 6) AS ema, round(sum(value) OVER (PARTITION BY runs.user_id ORDER BY runs.i), 6) AS total, consecutive_failures,
  coalesce(last_value(CASE WHEN ok THEN 'healthy' WHEN consecutive_failures >= 3 THEN 'unhealthy' END IGNORE NULLS) OVER (PARTITION BY runs.user_id ORDER BY runs.i ROWS UNBOUNDED PRECEDING), 'unknown') AS status
FROM runs JOIN averages ON averages.user_id = runs.user_id AND averages.i = runs.i""",
)
def stream_state(spark, folder):
    """Running values that outlive a micro-batch, for services that never fall silent for long."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STATE_PROVIDER)
    calls = event_stream(spark, folder).withColumn("ok", F.col("event_type") != "error")
    states = stateful.with_sequence_state(calls, "user_id", "value", "ok", ["ts", "event_id"])
    return drained(spark, states).select("event_id", "seq", "changed", F.round(F.col("ema") + OFF_TIES, 6).alias("ema"), F.round("total", 6).alias("total"), "consecutive_failures", "status")


@query("stream_q6_read_model", f"WITH {SQL_MODEL} SELECT {', '.join(MODEL_COLUMNS)} FROM model")
def stream_q6(spark, folder):
    """The read model kept up by a stream in three runs, some events sent twice, equals the one computed at once."""
    landing, store, model, offsets = (new_path(spark, n) for n in ("landing", "store", "model", "offsets"))
    events = envelopes(spark, folder)
    first, second = F.col("timestamp") < F.lit(AS_OF - timedelta(days=7)), F.col("timestamp") < F.lit(AS_OF)
    again = F.col("event_id").cast("long") % 10 == 0
    for part in (events.filter(first), events.filter(second & (~first | again)), events.filter(~second | again)):
        landed_messages(spark, messages.encode_messages(part, TOPIC_PREFIX), landing)
        stream = messages.decode_messages(messages.stream_files(spark, landing))
        consumers.consume(stream, "read-model", consumers.maintain_read_model(store, model, buckets=4), offsets).awaitTermination()
    consumers.compact_read_model(spark, model)
    return consumers.current_read_model(spark, model).select(*MODEL_COLUMNS)
