"""Account transfer and validation over accounts made from ``customer``, ``orders``, ``supplier``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrylog.functions.datetimes import iso_to_timestamp, timestamp_to_iso, timestamp_to_unix, unix_to_timestamp
from ferrylog.functions.payloads import object_or_empty
from ferrylog.operators.rows import keep_first
from ferrylog.plans import accounts, schema_check, validation
from ferrylog.session import load_table, materialise
from workloads.adapters import SQL_ACCOUNTS, source_admins, source_users, target_tables
from workloads.registry import AS_OF, query

WITH = f"WITH {SQL_ACCOUNTS} "
SQL_STATUS = """
CASE WHEN enabled = FALSE THEN 'disabled'
     WHEN expired OR expire_at < TIMESTAMP '2024-01-15' THEN 'expired'
     WHEN expire_strategy = 'start_on_first_use' AND NOT activated AND deadline > TIMESTAMP '2024-01-15' THEN 'on_hold'
     WHEN coalesce(data_limit, 0) > 0 AND coalesce(used_traffic, 0) >= data_limit AND data_limit_reached THEN 'limited'
     ELSE 'active' END"""
SQL_TRANSFORMED = f"""
transformed AS (
  SELECT username, {SQL_STATUS} AS status, coalesce(data_limit, 0) AS data_limit, coalesce(used_traffic, 0) AS used_traffic,
    epoch_us(coalesce(created, TIMESTAMP '2024-01-15')) AS created_us,
    epoch_us(greatest(coalesce(updated, TIMESTAMP '2024-01-15'), coalesce(created, TIMESTAMP '2024-01-15'))) AS edit_us,
    CASE WHEN {SQL_STATUS} <> 'on_hold' THEN CAST(epoch(expire_at) AS BIGINT) END AS expire,
    CASE WHEN {SQL_STATUS} = 'on_hold' THEN epoch_us(deadline) END AS hold_us,
    CASE WHEN {SQL_STATUS} = 'on_hold' THEN usage_duration END AS on_hold_expire_duration,
    'no_reset' AS data_limit_reset_strategy, note, seq
  FROM named
)"""


def flat_users(df):
    return df.select(
        "username",
        "status",
        "data_limit",
        "used_traffic",
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("edit_at").alias("edit_us"),
        "expire",
        F.unix_micros("on_hold_timeout").alias("hold_us"),
        "on_hold_expire_duration",
        "data_limit_reset_strategy",
        "note",
    )


@query("p4_user_transform", f"{WITH}, {SQL_TRANSFORMED} SELECT * EXCLUDE (seq) FROM transformed")
def p4(spark, folder):
    return flat_users(accounts.transform_users(source_users(spark, folder), AS_OF))


@query("p5_user_status", f"{WITH}, {SQL_TRANSFORMED} SELECT status, count(*) AS users FROM transformed GROUP BY status")
def p5(spark, folder):
    named = source_users(spark, folder).filter(accounts.has_text(F.col("username")))
    return named.groupBy(accounts.user_status(F.lit(AS_OF).cast("timestamp")).alias("status")).agg(F.count(F.lit(1)).alias("users"))


@query("p6_proxy_explode", WITH + "SELECT username, type, '{\"id\":\"' || uuid || '\"}' AS settings FROM proxied")
def p6(spark, folder):
    return accounts.transform_proxies(source_users(spark, folder))


SQL_ADMINS = (
    "SELECT username, 'NEEDS_RESET__' || md5(username) AS hashed_password, coalesce(is_sudo, FALSE) AS is_sudo, "
    "epoch_us(coalesce(created, TIMESTAMP '2024-01-15')) AS created_us, telegram_id, coalesce(users_usage, 0) AS users_usage FROM "
)


def flat_admins(df):
    return df.select("username", "hashed_password", "is_sudo", F.unix_micros("created_at").alias("created_us"), "telegram_id", "users_usage")


@query("p7_admin_transform", WITH + SQL_ADMINS + "source_admins WHERE username <> ''")
def p7(spark, folder):
    return flat_admins(accounts.transform_admins(source_admins(spark, folder), AS_OF))


def made_sets(spark, folder):
    return accounts.transform_accounts(source_users(spark, folder), source_admins(spark, folder), AS_OF)


@query(
    "p8_transform_users",
    f"{WITH}, {SQL_TRANSFORMED} SELECT * EXCLUDE (seq) FROM transformed WHERE seq IN (SELECT seq FROM first_users)",
)
def p8_users(spark, folder):
    return flat_users(made_sets(spark, folder)["users"])


@query(
    "p8_transform_proxies",
    WITH + "SELECT username, type, '{\"id\":\"' || uuid || '\"}' AS settings FROM proxied WHERE seq IN (SELECT seq FROM first_users)",
)
def p8_proxies(spark, folder):
    return made_sets(spark, folder)["proxies"]


@query("p8_transform_admins", WITH + SQL_ADMINS + "first_admins")
def p8_admins(spark, folder):
    return flat_admins(made_sets(spark, folder)["admins"])


@query(
    "p9_tolerant_transform",
    f"{WITH}, {SQL_TRANSFORMED} SELECT 'transformed' AS outcome, coalesce(status, '') AS detail, count(*) AS n FROM transformed JOIN named USING (seq) WHERE named.data_limit IS NOT NULL GROUP BY ALL "
    "UNION ALL SELECT 'set aside', CASE WHEN coalesce(username, '') = '' THEN 'missing username' ELSE 'no limit' END, count(*) FROM source_users "
    "WHERE coalesce(username, '') = '' OR data_limit IS NULL GROUP BY ALL".replace("coalesce(status, '')", "transformed.status"),
)
def p9(spark, folder):
    problem = F.when(F.col("data_limit").isNull(), "no limit")
    good, bad = accounts.split_transformable(source_users(spark, folder), problem)
    done = accounts.transform_users(good, AS_OF).groupBy(F.lit("transformed").alias("outcome"), F.col("status").alias("detail"))
    aside = bad.groupBy(F.lit("set aside").alias("outcome"), F.col("error").alias("detail"))
    return done.agg(F.count(F.lit(1)).alias("n")).unionByName(aside.agg(F.count(F.lit(1)).alias("n")))


@query(
    "a6_transform_summary",
    WITH + ", p AS (SELECT * FROM proxied WHERE seq IN (SELECT seq FROM first_users)) "
    "SELECT 'users' AS entity, count(*) AS rows FROM first_users UNION ALL SELECT 'admins', count(*) FROM first_admins UNION ALL SELECT 'proxies', count(*) FROM p "
    "UNION ALL SELECT 'users_by_key', count(*) FROM p JOIN first_users f USING (seq) WHERE coalesce(vless, '') = '' AND coalesce(vmess, '') = '' AND coalesce(shadowsocks, '') = '' "
    "UNION ALL SELECT 'users_without_proxy', count(*) FROM first_users WHERE seq NOT IN (SELECT seq FROM p)",
)
def a6(spark, folder):
    users = keep_first(source_users(spark, folder).filter(accounts.has_text(F.col("username"))), ["username"], ["seq"])
    admins = keep_first(source_admins(spark, folder).filter(accounts.has_text(F.col("username"))), ["username"], ["seq"])
    return accounts.transform_summary(users, admins)


@query(
    "p10_p11_write_coercion",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch_us(o_orderdate) END AS created_us, "
    "CASE WHEN o_orderkey % 2 = 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS expire, CAST(o_orderkey * 1000000 AS BIGINT) AS online_us, "
    "CASE WHEN o_orderkey % 4 <> 1 THEN CAST(o_orderkey AS INTEGER) END AS admin_id, CAST(o_custkey AS VARCHAR) AS note FROM orders",
)
def p11(spark, folder):
    k = F.col("o_orderkey")
    seconds = F.unix_seconds("o_orderdate").cast("string")
    loose = load_table(spark, folder, "orders").select(
        k.alias("id"),
        F.when(k % 3 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("created_at"),
        F.when(k % 2 == 0, seconds).otherwise(F.concat(F.lit("in "), seconds)).alias("expire"),
        k.alias("online_at"),
        F.when(k % 4 == 1, "none").otherwise(k.cast("string")).alias("admin_id"),
        F.col("o_custkey").alias("note"),
        F.lit("dropped").alias("service_ids"),
    )
    kept = accounts.prune_to_target(accounts.coerce_to_target(loose, accounts.USERS_SCHEMA), accounts.USERS_SCHEMA)
    return kept.select(
        F.col("id").cast("long").alias("id"), F.unix_micros("created_at").alias("created_us"), "expire", F.unix_micros("online_at").alias("online_us"), "admin_id", "note"
    )


@query(
    "p12_p13_object_or_empty",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE '{}' END AS settings FROM events",
)
def p12(spark, folder):
    events = load_table(spark, folder, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.col("props"), F.lit("}"))).otherwise("[1, 2]")
    return events.select("event_id", object_or_empty(text).alias("settings"))


@query(
    "j1_insert_if_absent",
    WITH + "SELECT username, seq FROM first_users WHERE username NOT IN (SELECT username FROM target_users)",
)
def j1(spark, folder):
    absent = accounts.insert_if_absent(source_users(spark, folder), target_tables(spark, folder)["users"], ["seq"])
    return absent.select("username", "seq")


@query(
    "j2_resolve_proxies",
    WITH + "SELECT t.id AS user_id, p.username, p.type, '{\"id\":\"' || uuid || '\"}' AS settings FROM proxied p JOIN target_users t USING (username)",
)
def j2(spark, folder):
    return accounts.resolve_proxies(accounts.transform_proxies(source_users(spark, folder)), target_tables(spark, folder)["users"])


@query("j3_orphan_proxies", WITH + "SELECT username, type FROM proxied WHERE username NOT IN (SELECT username FROM target_users)")
def j3(spark, folder):
    proxies = accounts.transform_proxies(source_users(spark, folder))
    return accounts.orphan_proxies(proxies, target_tables(spark, folder)["users"]).select("username", "type")


SQL_UUIDS = """
expected AS (
  SELECT username, type, uuid FROM proxied WHERE (username, seq) IN (SELECT (username, max(seq)) FROM proxied GROUP BY username)
), stored AS (
  SELECT user_id, upper(type) AS type, max_by(uuid, id) AS target_uuid FROM target_proxies WHERE uuid <> '' GROUP BY ALL
), judged AS (
  SELECT e.username, e.type, e.uuid AS source_uuid, s.target_uuid, CASE WHEN t.id IS NULL THEN 'user_missing' WHEN s.target_uuid IS NULL THEN 'proxy_missing'
    WHEN s.target_uuid <> e.uuid THEN 'uuid_mismatch' ELSE 'ok' END AS status
  FROM expected e LEFT JOIN target_users t USING (username) LEFT JOIN stored s ON s.user_id = t.id AND s.type = e.type
)"""


def judged_uuids(spark, folder):
    target = target_tables(spark, folder)
    return validation.uuid_validation(source_users(spark, folder), target["users"], target["proxies"])


@query("j4_uuid_validation", f"{WITH}, {SQL_UUIDS} SELECT * FROM judged")
def j4(spark, folder):
    return judged_uuids(spark, folder).drop("detail")


@query("t5_failure_sample", f"{WITH}, {SQL_UUIDS} SELECT username, type, status FROM judged WHERE status <> 'ok' ORDER BY username, type LIMIT 15")
def t5(spark, folder):
    return validation.failure_sample(judged_uuids(spark, folder)).select("username", "type", "status")


@query("a8_expected_proxies", f"{WITH}, {SQL_UUIDS} SELECT * FROM expected")
def a8(spark, folder):
    return validation.expected_proxies(source_users(spark, folder))


SQL_COUNTS = """
counted AS (
  SELECT *, CASE WHEN source_rows = target_rows THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM (
    SELECT 'users' AS entity, (SELECT count(*) FROM source_users) AS source_rows, (SELECT count(DISTINCT username) FROM named) AS source_distinct, (SELECT count(id) FROM target_users) AS target_rows
    UNION ALL SELECT 'admins', (SELECT count(*) FROM source_admins), (SELECT count(DISTINCT username) FROM source_admins), (SELECT count(id) FROM target_admins)
    UNION ALL SELECT 'proxies', (SELECT count(*) FROM proxied), (SELECT count(DISTINCT username) FROM proxied), (SELECT count(id) FROM target_proxies))
)"""


def counted(spark, folder):
    return validation.count_validation(source_users(spark, folder), source_admins(spark, folder), target_tables(spark, folder))


@query("j5_count_validation", f"{WITH}, {SQL_COUNTS} SELECT * FROM counted")
def j5(spark, folder):
    return counted(spark, folder)


@query("a3_count_entities", "SELECT count(*) AS rows FROM customer WHERE c_custkey % 3 <> 2")
def a3(spark, folder):
    return validation.count_entities(target_tables(spark, folder)["users"])


@query(
    "v1_all_validations",
    f"{WITH}, {SQL_UUIDS}, {SQL_COUNTS}, v AS (SELECT 'counts' AS validation, bool_and(status = 'MATCH') AS ok FROM counted "
    "UNION ALL SELECT 'uuids', bool_and(status = 'ok') FROM judged) FROM v UNION ALL SELECT 'all', bool_and(ok) FROM v",
)
def v1(spark, folder):
    return validation.all_valid(counted(spark, folder), judged_uuids(spark, folder))


@query(
    "v2_key_rules",
    WITH + """
SELECT 'users' AS "table", 'unique username' AS rule, count(*) AS violations FROM (SELECT username FROM source_users WHERE username IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'admins', 'unique username', count(*) FROM (SELECT username FROM target_admins WHERE username IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'admins', 'unique telegram_id', count(*) FROM (SELECT telegram_id FROM target_admins WHERE telegram_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'users', 'username not null', count(*) FROM source_users WHERE username IS NULL
UNION ALL SELECT 'admins', 'username not null', count(*) FROM target_admins WHERE username IS NULL
UNION ALL SELECT 'proxies', 'user_id in users', count(*) FROM target_proxies WHERE user_id NOT IN (SELECT seq FROM source_users)
UNION ALL SELECT 'users', 'admin_id in admins', count(*) FROM target_users WHERE admin_id IS NOT NULL AND id - 1 IN (SELECT seq FROM source_users) AND admin_id NOT IN (SELECT id FROM target_admins)
UNION ALL SELECT 'events', 'unique event_id', count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1)
""",
)
def v2(spark, folder):
    """Source names as users, so that repeated and missing names occur; users of events as event ids."""
    target = {name: materialise(df, name) for name, df in target_tables(spark, folder).items()}
    admin_of = target["users"].select((F.col("id") - 1).alias("id"), "admin_id")
    users = materialise(source_users(spark, folder).select("id", "username").join(admin_of, "id", "left"), "users")
    events = load_table(spark, folder, "events").select(F.col("user_id").alias("event_id"))
    return validation.key_rules(users, target["proxies"], target["admins"], events)


# ---- datetimes ----------------------------------------------------------------------------


@query(
    "f1_f4_datetimes",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) - 7200000000 WHEN 2 THEN epoch_us(date_trunc('day', ts)) END AS us, "
    "CASE event_id % 4 WHEN 0 THEN CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) WHEN 1 THEN CAST(floor((epoch_us(ts) - 7200000000) / 1000000) AS BIGINT) WHEN 2 THEN epoch_us(date_trunc('day', ts)) // 1000000 END AS unix, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS iso, "
    "CASE WHEN user_id % 2 = 0 THEN user_id * 1000000 END AS from_unix_us FROM events",
)
def f1_f4(spark, folder):
    kind, ts = F.col("event_id") % 4, F.col("ts")
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'123Z'"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS'+02:00'"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.date_format(ts, "yyyy-'13'-dd'T'HH:mm:ss"))
    )
    parsed = iso_to_timestamp(text)
    signed = F.when(F.col("user_id") % 2 == 0, F.col("user_id")).otherwise(-F.col("user_id"))
    return load_table(spark, folder, "events").select(
        "event_id",
        F.unix_micros(parsed).alias("us"),
        timestamp_to_unix(parsed).alias("unix"),
        timestamp_to_iso(ts).alias("iso"),
        F.unix_micros(unix_to_timestamp(signed)).alias("from_unix_us"),
    )


# ---- schema check -------------------------------------------------------------------------

SQL_PROFILE = """
typed AS (
  SELECT 'seq' AS field, CASE WHEN seq > 2147483647 THEN 'bigint' ELSE 'integer' END AS value_type FROM source_admins
  UNION ALL SELECT 'id', 'integer' FROM source_admins
  UNION ALL SELECT 'username', 'string' FROM source_admins
  UNION ALL SELECT 'is_sudo', CASE WHEN is_sudo IS NULL THEN 'string' ELSE 'boolean' END FROM source_admins
  UNION ALL SELECT 'created_at', CASE WHEN created IS NULL THEN 'string' ELSE 'datetime_iso' END FROM source_admins
  UNION ALL SELECT 'telegram_id', CASE WHEN telegram_id IS NULL THEN 'string' ELSE 'integer' END FROM source_admins
  UNION ALL SELECT 'users_usage', CASE WHEN users_usage IS NULL THEN 'string' ELSE 'integer' END FROM source_admins
  UNION ALL SELECT 'discord_webhook', 'string' FROM source_admins
  UNION ALL SELECT 'password_reset_at', 'string' FROM source_admins
)"""


@query("f12_type_profile", f"{WITH}, {SQL_PROFILE} SELECT field, value_type, count(*) AS values FROM typed GROUP BY ALL")
def f12(spark, folder):
    return schema_check.type_profile(source_admins(spark, folder))


@query(
    "f13_json_types",
    "SELECT value_type, count(*) AS n FROM (SELECT CASE event_id % 7 WHEN 0 THEN 'json' WHEN 1 THEN CASE WHEN user_id * 100000000 > 2147483647 THEN 'bigint' ELSE 'integer' END "
    "WHEN 2 THEN 'float' WHEN 3 THEN 'datetime_iso' WHEN 4 THEN 'uuid' WHEN 5 THEN 'boolean' ELSE 'string' END AS value_type FROM events) GROUP BY value_type",
)
def f13(spark, folder):
    from ferrylog.functions.identifiers import dashed
    from ferrylog.functions.payloads import json_value_type

    kind = F.col("event_id") % 7
    quote = F.lit('"')
    text = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, (F.col("user_id") * 100000000).cast("string"))
        .when(kind == 2, F.concat(F.col("user_id").cast("string"), F.lit(".5")))
        .when(kind == 3, F.concat(quote, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), quote))
        .when(kind == 4, F.concat(quote, dashed(F.md5(F.col("props").cast("binary"))), quote))
        .when(kind == 5, (F.col("user_id") > 5).cast("string"))
        .otherwise(F.concat(quote, F.col("event_type"), quote))
    )
    return load_table(spark, folder, "events").groupBy(json_value_type(text).alias("value_type")).agg(F.count(F.lit(1)).alias("n"))


SQL_FINDINGS = f"""
{SQL_PROFILE}, main AS (
  SELECT field, max_by(value_type, (n, value_type)) AS source_type FROM (SELECT field, value_type, count(*) AS n FROM typed
    WHERE value_type <> 'string' AND field <> 'seq' GROUP BY ALL UNION ALL SELECT 'username', 'string', 1 UNION ALL SELECT 'discord_webhook', 'string', 0 UNION ALL SELECT 'password_reset_at', 'string', 0) GROUP BY field
), wanted(field, target_type) AS (
  VALUES ('username', 'string'), ('hashed_password', 'string'), ('is_sudo', 'boolean'), ('created_at', 'datetime_iso'), ('password_reset_at', 'datetime_iso'),
    ('telegram_id', 'bigint'), ('discord_webhook', 'string'), ('users_usage', 'bigint')
), findings AS (
  SELECT coalesce(m.field, w.field) AS field, CASE WHEN m.field IS NULL THEN 'missing' WHEN w.field IS NULL THEN 'extra' WHEN source_type = target_type THEN 'compatible' ELSE 'incompatible' END AS finding,
    source_type, target_type FROM main m FULL JOIN wanted w ON m.field = w.field
)"""


def admin_findings(spark, folder):
    return schema_check.compare_fields(source_admins(spark, folder), schema_check.ADMIN_FIELDS)


@query("f14_j9_schema_findings", f"{WITH}, {SQL_FINDINGS} SELECT * FROM findings")
def f14(spark, folder):
    return admin_findings(spark, folder).select("field", "finding", "source_type", "target_type")


SQL_FIRST_FINDINGS = (
    "SELECT * FROM (VALUES ('username', 'compatible'), ('status', 'missing'), ('used_traffic', 'incompatible'), ('data_limit', 'incompatible'), ('expire', 'incompatible'), ('created_at', 'compatible'), "
    "('edit_at', 'incompatible'), ('note', 'compatible'), ('sub_revoked_at', 'incompatible'), ('sub_updated_at', 'incompatible'), ('sub_last_user_agent', 'compatible'), ('online_at', 'compatible'), "
    "('data_limit_reset_strategy', 'compatible'), ('admin_id', 'missing'), ('on_hold_timeout', 'missing'), ('on_hold_expire_duration', 'missing'), ('auto_delete_in_days', 'missing'), "
    "('last_status_change', 'missing'), ('id', 'extra'), ('key', 'extra'), ('proxies', 'extra'), ('enabled', 'extra'), ('activated', 'extra'), ('expired', 'extra'), ('data_limit_reached', 'extra'), "
    "('expire_strategy', 'extra'), ('usage_duration', 'extra'), ('activation_deadline', 'extra')) t(field, finding)"
)


@query("f14_first_record_findings", SQL_FIRST_FINDINGS)
def f14_first(spark, folder):
    found = schema_check.compare_fields(source_users(spark, folder), schema_check.USER_FIELDS, order=["seq"])
    return found.select("field", "finding")


@query(
    "f14_compatibility_score",
    f"{WITH}, {SQL_FINDINGS} SELECT count(*) FILTER (finding = 'compatible') AS compatible, count(*) FILTER (finding = 'incompatible') AS incompatible, "
    "count(*) FILTER (finding = 'missing') AS missing, count(*) FILTER (finding = 'extra') AS extra, count(*) FILTER (finding = 'compatible') / 8.0 AS score FROM findings",
)
def f14_score(spark, folder):
    return schema_check.compatibility_score(admin_findings(spark, folder), schema_check.ADMIN_FIELDS)


@query(
    "f15_conversion_advice",
    f"{WITH}, {SQL_FINDINGS} SELECT field, 'Review and fix ' || field || ' type conversion: ' || source_type || ' -> ' || target_type AS advice FROM findings WHERE finding = 'incompatible'",
)
def f15(spark, folder):
    return schema_check.conversion_advice(admin_findings(spark, folder))


@query(
    "f16_compatibility_report",
    f"{WITH}, {SQL_FINDINGS}, first AS ({SQL_FIRST_FINDINGS}), "
    "found AS (SELECT 'admins' AS section, 8.0 AS expected, finding FROM findings UNION ALL SELECT 'users', " + f"{len(schema_check.USER_FIELDS)}.0" + ", finding FROM first), "
    "metrics AS (SELECT section, any_value(expected) AS expected, count(*) FILTER (finding = 'compatible') AS compatible, count(*) FILTER (finding = 'incompatible') AS incompatible, "
    "count(*) FILTER (finding = 'missing') AS missing, count(*) FILTER (finding = 'extra') AS extra FROM found GROUP BY section) "
    "SELECT section, 'score' AS metric, CAST(compatible / expected AS DOUBLE) AS value FROM metrics UNION ALL SELECT section, 'compatible', compatible FROM metrics "
    "UNION ALL SELECT section, 'incompatible', incompatible FROM metrics UNION ALL SELECT section, 'missing', missing FROM metrics UNION ALL SELECT section, 'extra', extra FROM metrics",
)
def f16(spark, folder):
    """Users by their first record, admins by their commonest types."""
    first = schema_check.compare_fields(source_users(spark, folder), schema_check.USER_FIELDS, order=["seq"])
    users = schema_check.compatibility_score(first, schema_check.USER_FIELDS)
    return schema_check.compatibility_report(users, schema_check.compatibility_score(admin_findings(spark, folder), schema_check.ADMIN_FIELDS))


@query(
    "account_transfer",
    f"{WITH} SELECT 'users' AS entity, count(*) AS rows FROM first_users WHERE username NOT IN (SELECT username FROM target_users) "
    "UNION ALL SELECT 'admins', count(*) FROM first_admins WHERE username NOT IN (SELECT username FROM target_admins WHERE username IS NOT NULL) "
    "UNION ALL SELECT 'proxies', count(*) FROM proxied WHERE seq IN (SELECT seq FROM first_users)",
)
def flow(spark, folder):
    """Extracted sets through transform, coercion and insert-if-absent."""
    plan = accounts.transfer(source_users(spark, folder), source_admins(spark, folder), target_tables(spark, folder), AS_OF)
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("entity"), "rows") for n, df in plan.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
