"""Event history: selections, statistics, read models, replay, routing."""

from __future__ import annotations

import functools
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylog.plans import event_model, event_queries, read_models, run_state
from ferrylog.plans.event_model import ADMIN_MOVED, EVENT_SPECS, USER_MOVED
from ferrylog.session import load_table, new_path
from ferrylog.sources import event_store
from workloads.adapters import SQL_ENVELOPES, envelopes, raw_events
from workloads.registry import AS_OF, query

WITH = f"WITH {SQL_ENVELOPES} "
START, END = datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 20, tzinfo=timezone.utc)
SHORT = "event_id, event_type, aggregate_id, event_version, epoch_us(\"timestamp\") AS us"


def short(df):
    return df.select("event_id", "event_type", "aggregate_id", "event_version", F.unix_micros("timestamp").alias("us"))


@query("q1_by_aggregate", WITH + f"SELECT {SHORT} FROM envelopes WHERE aggregate_id = 'm7' AND event_version BETWEEN 2 AND 5")
def q1(spark, folder):
    return short(event_queries.by_aggregate(envelopes(spark, folder), "m7", 2, 5))


@query(
    "q2_by_type",
    WITH + f"SELECT {SHORT} FROM envelopes WHERE event_type = :user_moved AND \"timestamp\" BETWEEN '2024-01-05' AND '2024-01-20'",
)
def q2(spark, folder):
    return short(event_queries.by_types(envelopes(spark, folder), [USER_MOVED], START, END))


@query("q3_by_correlation", WITH + f"SELECT {SHORT} FROM envelopes WHERE correlation_id = 'c10'")
def q3(spark, folder):
    return short(event_queries.by_correlation(envelopes(spark, folder), "c10"))


@query("q4_all_events", WITH + f"SELECT {SHORT} FROM envelopes WHERE \"timestamp\" >= '2024-01-05' ORDER BY \"timestamp\", event_id LIMIT 100")
def q4(spark, folder):
    return short(event_queries.all_events(envelopes(spark, folder), START, limit=100))


@query(
    "q5_query_events",
    WITH + "SELECT 'aggregate' AS way, event_id FROM (FROM envelopes WHERE aggregate_id = 'm7' ORDER BY event_version, \"timestamp\", event_id LIMIT 20) "
    "UNION ALL SELECT 'correlation', event_id FROM (FROM envelopes WHERE correlation_id = 'c10' ORDER BY \"timestamp\", event_id LIMIT 20) "
    "UNION ALL SELECT 'types', event_id FROM (FROM envelopes WHERE event_type IN (:user_moved, 'data.imported') AND \"timestamp\" >= '2024-01-05' ORDER BY \"timestamp\", event_id LIMIT 20) "
    "UNION ALL SELECT 'all', event_id FROM (FROM envelopes WHERE \"timestamp\" >= '2024-01-05' ORDER BY \"timestamp\", event_id LIMIT 20)",
)
def q5(spark, folder):
    e = envelopes(spark, folder)
    types = [USER_MOVED, "data.imported"]
    ways = {
        "aggregate": dict(aggregate_id="m7", correlation_id="c10", event_types=types, start=START),
        "correlation": dict(correlation_id="c10", event_types=types, start=START),
        "types": dict(event_types=types, start=START),
        "all": dict(start=START),
    }
    parts = [event_queries.query_events(e, limit=20, **o).select(F.lit(w).alias("way"), "event_id") for w, o in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "o2_types_union",
    WITH + f"SELECT {SHORT} FROM envelopes WHERE event_type IN ('data.extracted', 'data.transformed', 'data.extracted')",
)
def o2(spark, folder):
    return short(event_queries.by_types(envelopes(spark, folder), ["data.extracted", "data.transformed", "data.extracted"]))


@query("t3_order_by_version", WITH + "SELECT event_id, event_version FROM envelopes ORDER BY event_version, \"timestamp\", event_id")
def t3(spark, folder):
    return envelopes(spark, folder).orderBy("event_version", "timestamp", "event_id").select("event_id", "event_version")


@query(
    "a4_event_statistics",
    WITH + "SELECT 'total' AS section, 'all' AS name, count(*) AS events, epoch_us(max(\"timestamp\")) AS latest_us FROM envelopes "
    "UNION ALL SELECT 'event_type', event_type, count(*), epoch_us(max(\"timestamp\")) FROM envelopes GROUP BY event_type "
    "UNION ALL SELECT 'aggregate_type', aggregate_type, count(*), epoch_us(max(\"timestamp\")) FROM envelopes GROUP BY aggregate_type",
)
def a4(spark, folder):
    stats = event_queries.event_statistics(envelopes(spark, folder))
    return stats.select("section", "name", "events", F.unix_micros("latest").alias("latest_us"))


@query(
    "a5_event_summary",
    WITH + "SELECT event_type, aggregate_type, count(*) AS event_count, epoch_us(min(\"timestamp\")) AS first_us, epoch_us(max(\"timestamp\")) AS last_us "
    "FROM envelopes GROUP BY event_type, aggregate_type ORDER BY event_count DESC",
)
def a5(spark, folder):
    return event_queries.event_summary(envelopes(spark, folder)).select(
        "event_type", "aggregate_type", "event_count", F.unix_micros("first_event").alias("first_us"), F.unix_micros("last_event").alias("last_us")
    )


@query(
    "j6_run_overview",
    "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus AS status, epoch_us(o_orderdate) AS started_us, "
    "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(3600 * (o_orderkey % 9) AS DOUBLE) END AS duration_seconds, count(l_orderkey) AS total_events "
    "FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL ORDER BY started_us DESC",
)
def j6(spark, folder):
    k = F.col("o_orderkey")
    statistics = load_table(spark, folder, "orders").select(
        k.cast("string").alias("run_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("started_at"),
        F.when(k % 5 != 0, F.timestamp_seconds(F.unix_seconds("o_orderdate") + k % 9 * 3600)).alias("completed_at"),
    )
    items = load_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("aggregate_id"), F.col("l_linenumber").alias("event_id")
    )
    overview = event_queries.run_overview(statistics, items)
    return overview.select("run_id", "status", F.unix_micros("started_at").alias("started_us"), "duration_seconds", "total_events")


EXPECTED = ["signup", "view", "purchase", "click"]
SQL_PLACED = """
placed AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events),
want AS (SELECT u.user_id, w.position, w.expected FROM (SELECT DISTINCT user_id FROM events) u,
  (VALUES (0, 'signup'), (1, 'view'), (2, 'purchase'), (3, 'click')) w(position, expected)),
differences AS (SELECT coalesce(p.user_id, w.user_id) AS user_id, coalesce(p.position, w.position) AS position, w.expected, p.event_type AS actual
  FROM placed p FULL JOIN want w ON p.user_id = w.user_id AND p.position = w.position WHERE w.expected IS DISTINCT FROM p.event_type)"""


@query("j8_sequence_differences", f"WITH {SQL_PLACED} SELECT * FROM differences")
def j8(spark, folder):
    return event_queries.sequence_differences(raw_events(spark, folder), EXPECTED, ["ts", "event_id"], "user_id")


@query(
    "j8_sequence_verdicts",
    f"WITH {SQL_PLACED} SELECT user_id, count(d.position) AS differences, count(d.position) = 0 AS is_valid FROM "
    "(SELECT DISTINCT user_id FROM events) LEFT JOIN differences d USING (user_id) GROUP BY user_id",
)
def j8_verdicts(spark, folder):
    return event_queries.sequence_verdicts(raw_events(spark, folder), EXPECTED, order=["ts", "event_id"], key="user_id")


SQL_MODEL = f"""{SQL_ENVELOPES}, starts AS (
  SELECT * FROM envelopes WHERE event_type = :run_started QUALIFY row_number() OVER (PARTITION BY mig ORDER BY "timestamp" DESC, event_id DESC) = 1
), linked AS (
  SELECT s.mig AS run_id, e.* FROM starts s JOIN envelopes e ON (e."timestamp", e.event_id) > (s."timestamp", s.event_id) AND (
    (e.event_type IN ('data.extracted', 'data.transformed', 'data.validated', 'data.imported', :user_moved, :admin_moved)
      AND e.correlation_id IN (s.mig, s.event_id, s.correlation_id))
    OR (e.event_type IN (:run_completed, :run_failed, 'rollback.initiated', 'rollback.completed') AND e.mig = s.mig))
), model AS (
  SELECT s.mig AS run_id, epoch_us(s."timestamp") AS started_us,
    coalesce(max_by(CASE l.event_type WHEN :run_completed THEN 'completed' ELSE 'failed' END, (l."timestamp", l.event_id)) FILTER (l.event_type IN (:run_completed, :run_failed)), 'started') AS status,
    coalesce(sum(l.k) FILTER (l.event_type = 'data.extracted'), 0)::BIGINT AS extracted_count,
    coalesce(sum(l.k) FILTER (l.event_type = 'data.transformed'), 0)::BIGINT AS transformed_count,
    coalesce(sum(l.k) FILTER (l.event_type = 'data.validated'), 0)::BIGINT AS validated_count,
    coalesce(sum(l.k) FILTER (l.event_type = 'data.imported'), 0)::BIGINT AS imported_count,
    count(*) FILTER (l.event_type = :user_moved) AS user_count,
    count(*) FILTER (l.event_type = :admin_moved) AS admin_count,
    2 * count(*) FILTER (l.event_type = 'data.validated' AND l.k % 2 = 1) AS error_count,
    max_by(round(l.value, 6), (l."timestamp", l.event_id)) FILTER (l.event_type = :run_completed) AS duration_seconds,
    max_by('failure ' || l.k, (l."timestamp", l.event_id)) FILTER (l.event_type = :run_failed) AS error_message,
    max_by('reason ' || l.k, (l."timestamp", l.event_id)) FILTER (l.event_type = 'rollback.initiated') AS rollback_reason,
    max_by(l.value > 10, (l."timestamp", l.event_id)) FILTER (l.event_type = 'rollback.completed') AS rollback_success
  FROM starts s LEFT JOIN linked l ON l.run_id = s.mig GROUP BY ALL
)"""
MODEL_COLUMNS = (
    "run_id status extracted_count transformed_count validated_count imported_count user_count admin_count error_count "
    "error_message rollback_reason rollback_success"
).split()


@query("q6_run_read_model", f"WITH {SQL_MODEL} SELECT * FROM model")
def q6(spark, folder):
    model = read_models.run_read_model(envelopes(spark, folder))
    return model.select(*MODEL_COLUMNS, F.unix_micros("started_at").alias("started_us"), F.round("duration_seconds", 6).alias("duration_seconds"))


@query(
    "q6_run_errors",
    f"WITH {SQL_MODEL} SELECT run_id, event_id, CAST(p AS INTEGER) AS position, ['bad name', 'bad key'][p + 1] AS error FROM linked, (SELECT unnest(range(2)) AS p) "
    "WHERE event_type = 'data.validated' AND k % 2 = 1",
)
def q6_errors(spark, folder):
    return read_models.run_errors(envelopes(spark, folder)).drop("timestamp")


@query(
    "j10_event_links",
    f"WITH {SQL_MODEL} SELECT run_id, event_id FROM linked",
)
def j10(spark, folder):
    e = envelopes(spark, folder)
    return read_models.linked_events(e, read_models.latest_starts(e)).select("run_id", "event_id")


@query(
    "q7_replay_result",
    WITH + "SELECT count(*) AS total_events, count(*) FILTER (value > 20 AND NOT (event_type = 'data.imported' AND k > 90)) AS processed_events, "
    "count(*) FILTER (value > 20 AND event_type = 'data.imported' AND k > 90) AS failed_events, "
    "round(count(*) FILTER (value > 20 AND NOT (event_type = 'data.imported' AND k > 90)) / count(*) * 100, 6) AS success_rate "
    "FROM envelopes JOIN (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id FROM events) USING (event_id) WHERE event_type LIKE 'data.%'",
)
def q7(spark, folder):
    done = _replay(spark, folder).result
    return done.withColumn("success_rate", F.round("success_rate", 6))


def _replay(spark, folder):
    """Replay the data events whose value is above 20; large imports fail."""
    e = envelopes(spark, folder).join(
        raw_events(spark, folder).select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), "value"), "event_id"
    )
    selection = event_queries.by_types(e, [t for t in EVENT_SPECS if t.startswith("data.")])
    count = F.get_json_object("event_data", "$.imported_count").try_cast("long")
    handlers = [
        read_models.Handler("imports", lambda d: d.groupBy("aggregate_type").count(), ("data.imported",), F.when(count > 90, "too many")),
        read_models.Handler("audit", event_model.audit_entries),
    ]
    return read_models.replay(selection, handlers, F.col("value") > 20)


@query("q7_replay_errors", WITH + "SELECT event_id, event_type, 'too many' AS error FROM envelopes WHERE value > 20 AND event_type = 'data.imported' AND k > 90")
def q7_errors(spark, folder):
    return _replay(spark, folder).errors.select("event_id", "event_type", "error")


@query(
    "q7_replay_outputs",
    WITH + "SELECT 'imports' AS handler, aggregate_type, count(*) AS n FROM envelopes WHERE value > 20 AND event_type = 'data.imported' AND k <= 90 GROUP BY ALL "
    "UNION ALL SELECT 'audit', aggregate_type, count(*) FROM envelopes WHERE value > 20 AND event_type LIKE 'data.%' AND NOT (event_type = 'data.imported' AND k > 90) GROUP BY ALL",
)
def q7_outputs(spark, folder):
    """What the handlers made of the events that passed."""
    made = _replay(spark, folder).outputs
    imports = made["imports"].select(F.lit("imports").alias("handler"), "aggregate_type", F.col("count").alias("n"))
    return imports.unionByName(made["audit"].groupBy(F.lit("audit").alias("handler"), "aggregate_type").agg(F.count(F.lit(1)).alias("n")))


@query(
    "q8_snapshots",
    f"WITH {SQL_MODEL.replace('FROM env' + chr(10), 'FROM env WHERE event_version <= 5' + chr(10), 1)} "
    "SELECT run_id AS aggregate_id, m.status, m.user_count, n.replayed, n.version, epoch_us(TIMESTAMP '2024-01-15') AS created_us FROM model m JOIN "
    "(SELECT aggregate_id, count(*) AS replayed, max(event_version) AS version FROM envelopes GROUP BY aggregate_id) n ON n.aggregate_id = m.run_id",
)
def q8(spark, folder):
    snaps = read_models.snapshots(envelopes(spark, folder), 5, as_of=F.lit(AS_OF).cast("timestamp"))
    status = F.get_json_object("snapshot_data", "$.status").alias("status")
    users = F.get_json_object("snapshot_data", "$.user_count").cast("long").alias("user_count")
    return snaps.select("aggregate_id", status, users, "replayed", "version", F.unix_micros("created_at").alias("created_us"))


CUTS = ("2024-01-08", "2024-01-15", "2024-12-31")


def _sql_resumed(number: int, cut: str) -> str:
    upto = f"WHERE \"timestamp\" <= '{cut}'"
    model = SQL_MODEL.replace("FROM env\n", f"FROM env {upto}\n", 1)
    own = f"SELECT aggregate_id, count(*) AS replayed, max(event_version) AS version FROM envelopes {upto} GROUP BY aggregate_id"
    columns = ", ".join(f"m.{c}" for c in MODEL_COLUMNS)
    return f"SELECT {number} AS cut, {columns}, replayed, version FROM (WITH {model} SELECT * FROM model) m JOIN ({WITH} {own}) n ON n.aggregate_id = m.run_id"


SQL_RESUMED = " UNION ALL ".join(_sql_resumed(i, cut) for i, cut in enumerate(CUTS))


@query("q8_resume", SQL_RESUMED)
def q8_resume(spark, folder):
    """The model at three moments, each resumed from the state stored at the one before; days before it are not read again."""
    store, states = new_path(spark, "store"), new_path(spark, "states")
    event_store.append_events(envelopes(spark, folder), store)
    resumed = []
    for i, cut in enumerate(CUTS):
        state = run_state.resume(spark, store, states, datetime.fromisoformat(cut).replace(tzinfo=timezone.utc), keep=len(CUTS))
        model = run_state.model_of(state).select("run_id", *[c for c in MODEL_COLUMNS if c != "run_id"])
        resumed.append(model.join(state.counts, "run_id", "left").withColumn("cut", F.lit(i)))
    return functools.reduce(DataFrame.unionByName, resumed).select("cut", *MODEL_COLUMNS, "replayed", "version")


@query(
    "q8_snapshot_upsert",
    "SELECT aggregate_id, version, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us FROM ("
    "SELECT o_custkey AS aggregate_id, max(o_orderkey) AS version, TIMESTAMP '2024-01-01' AS created_at, "
    "CASE WHEN o_custkey % 2 = 0 THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey "
    "UNION ALL SELECT o_custkey, max(o_orderkey), TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-15' FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey)",
)
def q8_upsert(spark, folder):
    newest = load_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("aggregate_id")).agg(F.max("o_orderkey").alias("version"))
    old = F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)).cast("timestamp")
    stored = newest.filter(F.col("aggregate_id") % 3 != 0).withColumns({"created_at": old, "updated_at": old})
    merged = read_models.upsert(stored, newest.filter("aggregate_id % 2 = 0 OR aggregate_id % 3 = 0"), "aggregate_id", F.lit(AS_OF).cast("timestamp"))
    return merged.select("aggregate_id", "version", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))


@query(
    "q9_incremental_projection",
    WITH + "SELECT event_type, aggregate_type, count(*) AS events FROM envelopes GROUP BY event_type, aggregate_type",
)
def q9(spark, folder):
    """Counts stored up to mid-month, advanced with what came after."""
    e = envelopes(spark, folder)
    seen = e.filter(F.col("timestamp") <= F.lit(AS_OF))
    keys = ["event_type", "aggregate_type"]
    stored = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
    mark = read_models.bookmark(seen, "counts").first()
    fresh = read_models.new_events(e, mark["last_processed_timestamp"], mark["last_processed_event_id"])
    return read_models.advance_counts(stored, fresh, keys)


@query(
    "q9_bookmark",
    WITH + "SELECT 'counts' AS projection_name, max_by(event_id, (\"timestamp\", event_id)) AS last_processed_event_id, epoch_us(max(\"timestamp\")) AS last_us FROM envelopes",
)
def q9_bookmark(spark, folder):
    mark = read_models.bookmark(envelopes(spark, folder), "counts")
    return mark.select("projection_name", "last_processed_event_id", F.unix_micros("last_processed_timestamp").alias("last_us"))


@query(
    "q10_moved_users",
    WITH + "SELECT aggregate_id, 'user_' || user_id AS username, epoch_us(max(\"timestamp\")) AS moved_us FROM envelopes WHERE event_type = :user_moved GROUP BY ALL",
)
def q10(spark, folder):
    users = read_models.moved_entities(envelopes(spark, folder))
    return users.select("aggregate_id", "username", F.unix_micros("moved_at").alias("moved_us"))


@query(
    "q10_moved_admins",
    WITH + "SELECT aggregate_id, 'user_' || user_id AS username, epoch_us(max(\"timestamp\")) AS moved_us FROM envelopes WHERE event_type = :admin_moved GROUP BY ALL",
)
def q10_admins(spark, folder):
    admins = read_models.moved_entities(envelopes(spark, folder), ADMIN_MOVED)
    return admins.select("aggregate_id", "username", F.unix_micros("moved_at").alias("moved_us"))


@query(
    "q11_routing",
    WITH + ", subs AS (SELECT DISTINCT 's' || event_version AS subscriber, event_type FROM envelopes) "
    "SELECT subscriber, event_type, count(*) AS n, min(event_id) AS first_id FROM subs JOIN envelopes USING (event_type) GROUP BY ALL",
)
def q11(spark, folder):
    e = envelopes(spark, folder)
    subscriptions = e.select(F.concat(F.lit("s"), F.col("event_version").cast("string")).alias("subscriber"), "event_type")
    routed = read_models.route_events(e.select("event_id", "event_type"), subscriptions)
    return routed.groupBy("subscriber", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


SQL_BUILT = " UNION ALL ".join(
    f"SELECT '{kind}' AS event_type, '{spec.aggregate_type}' AS aggregate_type, CAST(c_custkey AS VARCHAR) AS aggregate_id, epoch_us(TIMESTAMP '2024-01-15') AS us, 1 AS event_version, "
    f"c_mktsegment AS correlation_id, '{spec.fields[0]} ' || c_name AS detail, '{spec.fields[-1]} ' || c_name AS last_detail, '2024-01-15T00:00:00.000000' AS moment FROM customer"
    for kind, spec in EVENT_SPECS.items()
)


@query("p14_event_builders", SQL_BUILT)
def p14(spark, folder):
    """Every type's builder over all customers."""
    customers, out = load_table(spark, folder, "customer"), None
    for kind, spec in EVENT_SPECS.items():
        payload = {f: F.concat(F.lit(f"{f} "), "c_name") for f in spec.fields}
        made = event_model.make_events(customers, kind, F.col("c_custkey").cast("string"), F.lit(AS_OF).cast("timestamp"), payload, correlation_id=F.col("c_mktsegment"))
        text = lambda f: F.get_json_object("event_data", f"$.{f}")
        part = made.select(
            "event_type", "aggregate_type", "aggregate_id", F.unix_micros("timestamp").alias("us"), "event_version", "correlation_id",
            text(spec.fields[0]).alias("detail"), text(spec.fields[-1]).alias("last_detail"), text(spec.moment).alias("moment"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "s16_backfill",
    "SELECT :user_moved AS event_type, CAST(c_custkey AS VARCHAR) AS aggregate_id, c_name AS username, c_mktsegment AS segment, "
    "epoch_us(TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 500 AS INTEGER))) AS us, 36 AS id_length FROM customer",
)
def s16(spark, folder):
    customer = load_table(spark, folder, "customer")
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2020-01-01").cast("timestamp")) + F.col("c_custkey") % 500 * 86400)
    events = event_model.backfill_user_events(customer, F.col("c_custkey").cast("string"), F.col("c_name"), at)
    data = F.col("event_data")
    return events.select(
        "event_type",
        "aggregate_id",
        F.get_json_object(data, "$.username").alias("username"),
        F.get_json_object(data, "$.source_data.c_mktsegment").alias("segment"),
        F.unix_micros("timestamp").alias("us"),
        F.length("event_id").alias("id_length"),
    )


@query(
    "p15_audit",
    "SELECT CAST(doc_id AS VARCHAR) AS event_id, CASE WHEN length(text) > 100 THEN '<string: ' || left(text, 100) || '...>' ELSE text END AS text, "
    "'<dict with 2 keys>' AS about, '<list with 3 items>' AS tags, CAST(n_chars AS VARCHAR) AS n_chars FROM documents",
)
def p15(spark, folder):
    """Document texts as payloads: whole texts go in, the audit entry keeps a head."""
    docs = load_table(spark, folder, "documents")
    about = F.struct(F.col("lang").alias("lang"), F.col("source").alias("source"))
    data = F.to_json(F.struct("text", about.alias("about"), F.array("lang", "source", F.lit("doc")).alias("tags"), "n_chars"))
    none = F.lit(None).cast("string")
    events = docs.select(
        F.col("doc_id").cast("string").alias("event_id"), F.lit("data.imported").alias("event_type"), F.col("source").alias("aggregate_id"),
        F.lit("import").alias("aggregate_type"), F.lit(AS_OF).cast("timestamp").alias("timestamp"), none.alias("correlation_id"),
        none.alias("causation_id"), F.lit("{}").alias("event_metadata"), data.alias("event_data"),
    )
    summary = F.col("data_summary")
    return event_model.audit_entries(events).select("event_id", *[summary[c].alias(c) for c in ("text", "about", "tags", "n_chars")])


@query(
    "p16_notifications",
    WITH + "SELECT event_id, CASE event_type WHEN :run_completed THEN :completed_title WHEN :run_failed THEN :failed_title "
    "WHEN 'rollback.initiated' THEN 'Rollback Initiated' ELSE 'Rollback Completed' END AS title, "
    "CASE event_type WHEN :run_completed THEN printf(:completed_text, aggregate_id, value) "
    "WHEN :run_failed THEN printf(:failed_text, aggregate_id, 'failure ' || k) "
    "WHEN 'rollback.initiated' THEN printf(:initiated_text, 'r' || event_id, mig, 'reason ' || k) "
    "ELSE printf(:undone_text, 'r' || event_id, mig, CASE WHEN value > 10 THEN 'successfully' ELSE 'with errors' END) END AS message, "
    "CASE event_type WHEN :run_completed THEN 'normal' WHEN :run_failed THEN 'high' WHEN 'rollback.initiated' THEN 'high' "
    "ELSE CASE WHEN value > 10 THEN 'medium' ELSE 'high' END END AS priority "
    "FROM envelopes WHERE event_type IN (:run_completed, :run_failed) OR event_type LIKE 'rollback.%'",
)
def p16(spark, folder):
    return event_model.notifications(envelopes(spark, folder)).select("event_id", "title", "message", "priority")


@query(
    "p17_event_filter",
    WITH + "SELECT count(*) AS total, count(*) FILTER (event_version > 3) AS kept, count(*) FILTER (event_version <= 3) AS left_out FROM envelopes",
)
def p17(spark, folder):
    wanted = F.col("event_version") > 3
    return envelopes(spark, folder).agg(F.count(F.lit(1)).alias("total"), F.count_if(wanted).alias("kept"), F.count_if(~wanted).alias("left_out"))
