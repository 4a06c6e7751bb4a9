"""The given tables in the shapes the library works on, with the same mapping as SQL.

``events`` become event envelopes, call logs and metric samples; ``customer`` with ``orders``
become source users; ``supplier`` becomes source admins; ``orders`` become a transaction log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylog.functions.identifiers import dashed
from ferrylog.functions.payloads import payload_long
from ferrylog.operators.ordering import with_seq
from ferrylog.plans.event_model import ADMIN_MOVED, EVENT_SCHEMA, EVENT_SPECS, RUN_COMPLETED, RUN_FAILED, RUN_ID, RUN_STARTED, USER_MOVED
from ferrylog.session import load_table

# ---- events -------------------------------------------------------------------------------

SQL_ENVELOPES = """
raw AS (
  SELECT *, CAST(props->>'$.k' AS BIGINT) AS k, 'm' || user_id AS mig FROM events
), env AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, ts AS "timestamp", user_id, value, k, mig,
    CASE event_type
      WHEN 'signup' THEN :run_started
      WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'data.extracted' ELSE 'data.transformed' END
      WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'data.validated' ELSE 'data.imported' END
      WHEN 'purchase' THEN CASE WHEN k % 4 <> 0 THEN :user_moved ELSE :admin_moved END
      ELSE CASE WHEN k % 3 = 0 THEN :run_completed WHEN k % 3 = 1 THEN :run_failed
                WHEN k % 2 = 0 THEN 'rollback.initiated' ELSE 'rollback.completed' END
    END AS event_type,
    CAST(event_id % 7 + 1 AS INTEGER) AS event_version,
    CASE WHEN user_id % 3 = 1 THEN 'c' || user_id WHEN user_id % 3 = 2 AND k % 10 = 9 THEN NULL ELSE mig END AS correlation_id
  FROM raw
), envelopes AS (
  SELECT *,
    CASE WHEN event_type IN (:run_started, :run_completed, :run_failed) THEN mig
         WHEN event_type IN (:user_moved, :admin_moved) THEN 'u' || user_id
         WHEN event_type LIKE 'rollback.%' THEN 'r' || event_id ELSE 'a' || event_id END AS aggregate_id,
    CASE event_type
      WHEN 'data.extracted' THEN 'extraction' WHEN 'data.transformed' THEN 'transformation'
      WHEN 'data.validated' THEN 'validation' WHEN 'data.imported' THEN 'import'
      WHEN :user_moved THEN 'user' WHEN :admin_moved THEN 'admin'
      WHEN 'rollback.initiated' THEN 'rollback' WHEN 'rollback.completed' THEN 'rollback'
      ELSE :run END AS aggregate_type
  FROM env
)"""


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "events")


def envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as event envelopes with JSON payloads."""
    raw = raw_events(spark, folder)
    k, kind = payload_long(F.col("props"), "k"), F.col("event_type")
    even = F.col("k") % 2 == 0
    mapped = (
        F.when(kind == "signup", RUN_STARTED)
        .when(kind == "view", F.when(even, "data.extracted").otherwise("data.transformed"))
        .when(kind == "click", F.when(F.col("k") % 3 == 0, "data.validated").otherwise("data.imported"))
        .when(kind == "purchase", F.when(F.col("k") % 4 != 0, USER_MOVED).otherwise(ADMIN_MOVED))
        .when(F.col("k") % 3 == 0, RUN_COMPLETED)
        .when(F.col("k") % 3 == 1, RUN_FAILED)
        .when(even, "rollback.initiated")
        .otherwise("rollback.completed")
    )
    user = F.col("user_id").cast("string")
    run = F.concat(F.lit("m"), user)
    rows = raw.withColumn("k", k).withColumns(
        {
            "_id": F.lpad(F.col("event_id").cast("string"), 12, "0"),
            "_type": mapped,
            "_mig": run,
            "_user": F.concat(F.lit("user_"), user),
        }
    )
    kind = F.col("_type")
    own = kind.isin(RUN_STARTED, RUN_COMPLETED, RUN_FAILED)
    person = kind.isin(USER_MOVED, ADMIN_MOVED)
    aggregate = (
        F.when(own, F.col("_mig"))
        .when(person, F.concat(F.lit("u"), user))
        .when(kind.startswith("rollback."), F.concat(F.lit("r"), F.col("_id")))
        .otherwise(F.concat(F.lit("a"), F.col("_id")))
    )
    aggregate_type = F.create_map(*[F.lit(x) for t, s in EVENT_SPECS.items() for x in (t, s.aggregate_type)])
    correlation = F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("c"), user)).when(
        (F.col("user_id") % 3 == 2) & (F.col("k") % 10 == 9), F.lit(None)
    ).otherwise(F.col("_mig"))

    def only(types: tuple[str, ...], value: Column) -> Column:
        return F.when(kind.isin(*types), value)

    data = F.to_json(
        F.struct(
            only(("data.extracted",), F.col("k")).alias("record_count"),
            only(("data.transformed",), F.col("k")).alias("output_count"),
            only(("data.validated",), F.col("k")).alias("valid_records"),
            only(("data.validated",), F.col("k") % 2).alias("invalid_records"),
            F.when((kind == "data.validated") & (F.col("k") % 2 == 1), F.array(F.lit("bad name"), F.lit("bad key"))).alias("validation_errors"),
            only(("data.imported",), F.col("k")).alias("imported_count"),
            only((RUN_COMPLETED,), F.col("value")).alias("duration_seconds"),
            only((RUN_FAILED,), F.concat(F.lit("failure "), F.col("k").cast("string"))).alias("error_message"),
            only(("rollback.initiated", "rollback.completed"), F.col("_mig")).alias(RUN_ID),
            only(("rollback.initiated",), F.concat(F.lit("reason "), F.col("k").cast("string"))).alias("reason"),
            only(("rollback.completed",), F.col("value") > 10).alias("success"),
            only((USER_MOVED, ADMIN_MOVED), F.col("_user")).alias("username"),
        )
    )
    columns = {
        "event_id": F.col("_id"),
        "event_type": kind,
        "aggregate_id": aggregate,
        "aggregate_type": F.element_at(aggregate_type, kind),
        "event_version": F.col("event_id") % 7 + 1,
        "timestamp": F.col("ts"),
        "correlation_id": correlation,
        "causation_id": F.lit(None),
        "event_metadata": F.lit('{"origin":"panel"}'),
        "event_data": data,
    }
    return rows.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])


SQL_SAMPLES = """
samples AS (
  SELECT event_type AS source, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq,
    user_id AS queue_length, value AS latency, CAST(props->>'$.k' AS DOUBLE) AS throughput,
    CAST(10 + event_id % 50 AS DOUBLE) AS rate
  FROM events
)"""


def metric_samples(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as metric samples per event type."""
    rows = with_seq(raw_events(spark, folder), ["ts", "event_id"], ["event_type"])
    return rows.select(
        F.col("event_type").alias("source"),
        "event_id",
        "seq",
        F.col("user_id").alias("queue_length"),
        F.col("value").alias("latency"),
        payload_long(F.col("props"), "k").cast("double").alias("throughput"),
        (F.lit(10) + F.col("event_id") % 50).cast("double").alias("rate"),
    )


# ---- accounts -----------------------------------------------------------------------------

SQL_ACCOUNTS = """
spent AS (
  SELECT o_custkey, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
    min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey
), source_users AS (
  SELECT c_custkey AS seq, c_custkey AS c,
    CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_custkey % 50 = 8 THEN ''
         WHEN c_custkey % 40 = 3 THEN 'user_' || (c_custkey - 1) ELSE 'user_' || c_custkey END AS username,
    CASE WHEN c_custkey % 5 = 0 THEN 'bad-key-' || c_custkey ELSE md5(c_name) END AS "key",
    CASE WHEN c_custkey % 3 = 0 THEN regexp_replace(md5('vless' || c_custkey), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS vless,
    CASE WHEN c_custkey % 4 = 0 THEN regexp_replace(md5('vmess' || c_custkey), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS vmess,
    CASE WHEN c_custkey % 14 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN regexp_replace(md5('shadow' || c_custkey), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS shadowsocks,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 11 <> 0 END AS enabled,
    c_custkey % 2 = 0 AS activated, c_custkey % 17 = 0 AS expired, c_custkey % 8 = 1 AS data_limit_reached,
    CASE WHEN c_custkey % 6 = 5 THEN NULL WHEN c_custkey % 4 = 1 THEN CAST(floor(coalesce(cents, 0) / 2) AS BIGINT) ELSE coalesce(cents, 0) * 2 END AS data_limit,
    cents AS used_traffic,
    CASE WHEN c_custkey % 9 = 1 THEN NULL WHEN c_custkey % 9 <> 0 THEN TIMESTAMP '2024-01-15 10:00:00' + to_days(CAST(c_custkey % 61 - 30 AS INTEGER)) END AS expire_at,
    CASE WHEN c_custkey % 5 = 2 THEN 'start_on_first_use' ELSE 'fixed_date' END AS expire_strategy,
    TIMESTAMP '2024-01-15 00:00:00' + to_days(CAST(c_custkey % 31 - 10 AS INTEGER)) AS deadline,
    c_custkey % 100 * 3600 AS usage_duration,
    CASE WHEN c_custkey % 10 = 4 THEN last_order ELSE first_order END AS created,
    CASE WHEN c_custkey % 12 = 0 THEN NULL WHEN c_custkey % 10 = 4 THEN first_order ELSE last_order END AS updated,
    c_mktsegment AS note
  FROM customer LEFT JOIN spent ON c_custkey = o_custkey
), named AS (
  SELECT * FROM source_users WHERE username <> ''
), proxied AS (
  SELECT seq, username, 'VLESS' AS type, vless AS uuid FROM named WHERE vless <> ''
  UNION ALL SELECT seq, username, 'VMESS', vmess FROM named WHERE vmess <> ''
  UNION ALL SELECT seq, username, 'SHADOWSOCKS', shadowsocks FROM named WHERE shadowsocks <> ''
  UNION ALL SELECT seq, username, 'VLESS', regexp_replace("key", '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') FROM named
    WHERE coalesce(vless, '') = '' AND coalesce(vmess, '') = '' AND coalesce(shadowsocks, '') = '' AND regexp_matches("key", '^[0-9a-f]{32}$')
), first_users AS (
  SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY username ORDER BY seq) = 1
), source_admins AS (
  SELECT s_suppkey AS seq, s_suppkey AS s,
    CASE WHEN s_suppkey % 20 = 3 THEN NULL WHEN s_suppkey % 10 = 4 THEN 'admin_' || (s_suppkey - 1) ELSE 'admin_' || s_suppkey END AS username,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 2 = 0 END AS is_sudo,
    CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 25 * 1000 END AS telegram_id,
    CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(round(s_acctbal * 100) AS BIGINT) END AS users_usage,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE TIMESTAMP '2023-01-01 08:00:00' + to_days(CAST(s_suppkey % 300 AS INTEGER)) END AS created
  FROM supplier
), first_admins AS (
  SELECT * FROM source_admins WHERE username <> '' QUALIFY row_number() OVER (PARTITION BY username ORDER BY seq) = 1
), target_users AS (
  SELECT c_custkey + 1 AS id, 'user_' || c_custkey AS username, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 130 END AS admin_id
  FROM customer WHERE c_custkey % 3 <> 2
), target_admins AS (
  SELECT s AS id, username, telegram_id FROM source_admins
), target_proxies AS (
  SELECT c_custkey * 4 + 1 AS id, c_custkey + 1 AS user_id, 'vless' AS type,
    regexp_replace(md5((CASE WHEN c_custkey % 18 = 0 THEN 'other' ELSE 'vless' END) || c_custkey), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid
  FROM customer WHERE c_custkey % 3 = 0
  UNION ALL
  SELECT c_custkey * 4 + 2, c_custkey + 1, 'VMESS',
    CASE WHEN c_custkey % 16 = 0 THEN NULL ELSE regexp_replace(md5('vmess' || c_custkey), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END
  FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 24 <> 8
)"""


def _hashed(prefix: str) -> Column:
    return dashed(F.md5(F.concat(F.lit(prefix), F.col("c_custkey").cast("string")).cast("binary")))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _shifted(base: str, days: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit(base).cast("timestamp")) + days * 86400)


def source_users(spark: SparkSession, folder: str) -> DataFrame:
    """``customer`` with order totals as source users, odd rows included."""
    spent = load_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
    )
    c = F.col("c_custkey")
    text = c.cast("string")
    none = F.lit(None)
    used = F.coalesce("cents", F.lit(0))

    def detail(value: Column) -> Column:
        return F.struct(value.cast("string").alias("id"))

    expires = F.when(c % 9 == 1, none).when(c % 9 == 0, "not a date").otherwise(_iso(_shifted("2024-01-15 10:00:00", c % 61 - 30)))
    first, last = _iso(F.col("first_order")), _iso(F.col("last_order"))
    rows = load_table(spark, folder, "customer").join(spent, "c_custkey", "left")
    return rows.select(
        c.alias("seq"),
        c.alias("id"),
        F.when(c % 50 == 7, none)
        .when(c % 50 == 8, "")
        .when(c % 40 == 3, F.concat(F.lit("user_"), (c - 1).cast("string")))
        .otherwise(F.concat(F.lit("user_"), text))
        .alias("username"),
        F.when(c % 5 == 0, F.concat(F.lit("bad-key-"), text)).otherwise(F.md5(F.col("c_name").cast("binary"))).alias("key"),
        F.struct(
            detail(F.when(c % 3 == 0, _hashed("vless"))).alias("vless"),
            detail(F.when(c % 4 == 0, _hashed("vmess"))).alias("vmess"),
            detail(none).alias("trojan"),
            detail(F.when(c % 14 == 0, "").when(c % 7 == 0, _hashed("shadow"))).alias("shadowsocks"),
        ).alias("proxies"),
        F.when(c % 13 != 0, c % 11 != 0).alias("enabled"),
        (c % 2 == 0).alias("activated"),
        (c % 17 == 0).alias("expired"),
        (c % 8 == 1).alias("data_limit_reached"),
        F.when(c % 6 == 5, none).when(c % 4 == 1, F.floor(used / 2)).otherwise(used * 2).cast("long").alias("data_limit"),
        F.col("cents").alias("used_traffic"),
        expires.alias("expire_date"),
        F.when(c % 5 == 2, "start_on_first_use").otherwise("fixed_date").alias("expire_strategy"),
        (c % 100 * 3600).alias("usage_duration"),
        _iso(_shifted("2024-01-15 00:00:00", c % 31 - 10)).alias("activation_deadline"),
        none.cast("string").alias("data_limit_reset_strategy"),
        F.col("c_mktsegment").alias("note"),
        F.when(c % 10 == 4, last).otherwise(first).alias("created_at"),
        F.when(c % 12 != 0, F.when(c % 10 == 4, first).otherwise(last)).alias("updated_at"),
        none.cast("string").alias("sub_revoked_at"),
        none.cast("string").alias("sub_updated_at"),
        none.cast("string").alias("sub_last_user_agent"),
        last.alias("online_at"),
    )


def source_admins(spark: SparkSession, folder: str) -> DataFrame:
    """``supplier`` as source admins."""
    s = F.col("s_suppkey")
    none = F.lit(None)
    return load_table(spark, folder, "supplier").select(
        s.alias("seq"),
        s.alias("id"),
        F.when(s % 20 == 3, none)
        .when(s % 10 == 4, F.concat(F.lit("admin_"), (s - 1).cast("string")))
        .otherwise(F.concat(F.lit("admin_"), s.cast("string")))
        .alias("username"),
        F.when(s % 3 != 0, s % 2 == 0).alias("is_sudo"),
        F.when(s % 7 != 0, _iso(_shifted("2023-01-01 08:00:00", s % 300))).alias("created_at"),
        F.when(s % 4 != 0, s % 25 * 1000).alias("telegram_id"),
        F.when(s % 6 != 0, F.round(F.col("s_acctbal") * 100).cast("long")).alias("users_usage"),
        none.cast("string").alias("discord_webhook"),
        none.cast("string").alias("password_reset_at"),
    )


def target_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A target that holds some of the accounts, with some differences."""
    customer = load_table(spark, folder, "customer")
    c = F.col("c_custkey")
    name = F.concat(F.lit("user_"), c.cast("string"))
    users = customer.filter(c % 3 != 2).select((c + 1).alias("id"), name.alias("username"), F.when(c % 4 != 0, c % 130).alias("admin_id"))
    admins = source_admins(spark, folder).select("id", "username", "telegram_id")

    def settings(uuid: Column) -> Column:
        return F.to_json(F.struct(uuid.alias("id")))

    vless = customer.filter(c % 3 == 0).select(
        (c * 4 + 1).alias("id"),
        (c + 1).alias("user_id"),
        F.lit("vless").alias("type"),
        settings(F.when(c % 18 == 0, _hashed("other")).otherwise(_hashed("vless"))).alias("settings"),
    )
    vmess = customer.filter((c % 4 == 0) & (c % 24 != 8)).select(
        (c * 4 + 2).alias("id"),
        (c + 1).alias("user_id"),
        F.lit("VMESS").alias("type"),
        F.when(c % 16 == 0, "no json").otherwise(settings(_hashed("vmess"))).alias("settings"),
    )
    return {"users": users, "admins": admins, "proxies": vless.unionByName(vmess)}


# ---- identifiers --------------------------------------------------------------------------

SQL_IDENTIFIERS = """
identifiers AS (
  SELECT c_custkey AS seq,
    CASE WHEN c_custkey % 3 = 0 THEN md5(c_name)
         WHEN c_custkey % 3 = 1 THEN ' ' || upper(regexp_replace(md5(c_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')) || ' '
         ELSE c_mktsegment END AS value
  FROM customer
)"""


def identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Hex, padded dashed and invalid identifiers from ``customer``."""
    c, digest = F.col("c_custkey"), F.md5(F.col("c_name").cast("binary"))
    value = (
        F.when(c % 3 == 0, digest)
        .when(c % 3 == 1, F.concat(F.lit(" "), F.upper(dashed(digest)), F.lit(" ")))
        .otherwise(F.col("c_mktsegment"))
    )
    return load_table(spark, folder, "customer").select(c.alias("seq"), value.alias("value"))


# ---- transaction log ----------------------------------------------------------------------

OPERATIONS_PER_TRANSACTION = 50

SQL_OPERATIONS = """
operations AS (
  SELECT lpad(CAST(o_orderkey // 50 AS VARCHAR), 10, '0') AS transaction_id, o_orderkey % 50 AS pos, o_orderkey AS o,
    'user_' || o_custkey AS username, o_orderdate AS made_at,
    CASE o_orderkey % 3 WHEN 0 THEN 'insert_user' WHEN 1 THEN 'update_user' ELSE 'delete_user' END AS operation_type,
    CASE o_orderkey % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'restore' ELSE 'reinsert' END AS action,
    NOT (o_orderkey % 3 = 1 AND o_orderkey % 5 = 1) AS undoable,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS old_status,
    o_orderkey % 3 = 2 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0) AS has_limit,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS old_limit
  FROM orders
), account_rows AS (
  SELECT 'user_' || c_custkey AS username, c_mktsegment AS status, c_custkey * 10 AS data_limit FROM customer
)"""


def transaction_log(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as logged account changes, at most 50 per transaction."""
    o = F.col("o_orderkey")
    name = F.concat(F.lit("user_"), F.col("o_custkey").cast("string"))
    keep = {"ignoreNullFields": "false"}
    limit = F.when(o % 7 != 0, o).alias("data_limit")
    status = F.col("o_orderstatus").alias("status")
    full = F.to_json(F.struct(name.alias("username"), status, limit), keep)
    part = F.to_json(F.struct(name.alias("username"), status), keep)
    rollback = F.when(o % 3 == 2, full).when((o % 3 == 1) & (o % 5 != 1), F.when(o % 2 == 0, full).otherwise(part))
    operation = F.struct(
        o.alias("_o"),
        F.concat(F.lit("op-"), o.cast("string")).alias("operation_id"),
        F.when(o % 3 == 0, "insert_user").when(o % 3 == 1, "update_user").otherwise("delete_user").alias("operation_type"),
        F.lit("users").alias("target_table"),
        F.to_json(F.struct(name.alias("username"), F.col("o_totalprice").alias("price"))).alias("operation_data"),
        rollback.alias("rollback_data"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )
    number = F.floor(o / OPERATIONS_PER_TRANSACTION).cast("long")
    # moved while still narrow; the JSON texts are made where they are gathered
    orders = load_table(spark, folder, "orders").withColumn("_t", number).repartition("_t")
    grouped = orders.select("_t", "o_orderdate", operation.alias("_op")).groupBy("_t").agg(
        F.sort_array(F.collect_list("_op")).alias("_ops"), F.min("o_orderdate").alias("_start")
    )
    tid = F.lpad(F.col("_t").cast("string"), 10, "0")
    size = F.size("_ops")
    checkpoint = F.struct(
        F.concat(F.lit("cp-"), tid).alias("checkpoint_id"),
        tid.alias("transaction_id"),
        F.floor(size / 2).cast("long").alias("operation_count"),
        F.lit("{}").alias("checkpoint_data"),
        F.date_format("_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )
    return grouped.select(
        tid.alias("transaction_id"),
        F.when(F.col("_t") % 4 == 3, "rolled_back").otherwise("committed").alias("status"),
        F.date_format("_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_time"),
        F.lit(None).cast("string").alias("end_time"),
        F.create_map(F.lit("operation"), F.lit("import")).alias("metadata"),
        F.transform("_ops", lambda x: x.dropFields("_o")).alias("operations"),
        F.when(F.col("_t") % 2 == 0, F.array(checkpoint)).otherwise(F.array()).alias("checkpoints"),
    )


def account_rows(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c_custkey")
    return load_table(spark, folder, "customer").select(
        F.concat(F.lit("user_"), c.cast("string")).alias("username"), F.col("c_mktsegment").alias("status"), (c * 10).alias("data_limit")
    )
