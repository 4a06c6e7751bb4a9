"""Identifier normalisation over ``customer`` names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrylog.functions.identifiers import FORMAT_HEX, is_valid_uuid, key_to_uuid, transform_uuid, uuid_format
from ferrylog.plans import identifier_report
from ferrylog.session import load_table
from workloads.adapters import SQL_IDENTIFIERS, identifiers
from workloads.registry import query

SPLIT = "'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5'"
SQL_TRANSFORMED = f"""
{SQL_IDENTIFIERS}, t AS (
  SELECT seq, value, CASE seq % 3 WHEN 0 THEN 'hex_32' WHEN 1 THEN 'uuid_standard' ELSE 'invalid' END AS format,
    CASE seq % 3 WHEN 0 THEN regexp_replace(value, {SPLIT}) WHEN 1 THEN trim(value) END AS transformed FROM identifiers
)"""


@query("f5_key_to_uuid", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN regexp_replace(md5(c_name), {SPLIT}) END AS uuid FROM customer")
def f5(spark, folder):
    customer = load_table(spark, folder, "customer")
    key = F.when(F.col("c_custkey") % 2 == 0, F.md5(F.col("c_name").cast("binary"))).otherwise(F.rpad(F.col("c_name"), 32, "x"))
    return customer.select("c_custkey", key_to_uuid(key).alias("uuid"))


@query("f6_uuid_format", f"WITH {SQL_TRANSFORMED} SELECT seq, format FROM t")
def f6(spark, folder):
    return identifiers(spark, folder).select("seq", uuid_format(F.col("value")).alias("format"))


@query(
    "f7_f9_transform_uuid",
    f"WITH {SQL_TRANSFORMED} SELECT seq, value AS original, transformed, format, transformed IS NOT NULL AS is_valid, "
    "CASE WHEN transformed IS NULL THEN 'Invalid UUID format detected' END AS error FROM t",
)
def f9(spark, folder):
    return identifiers(spark, folder).select("seq", transform_uuid(F.col("value")).alias("_u")).select("seq", "_u.*")


@query("f7_to_hex", f"WITH {SQL_TRANSFORMED} SELECT seq, replace(transformed, '-', '') AS transformed, transformed IS NOT NULL AS is_valid FROM t")
def f7_hex(spark, folder):
    made = identifiers(spark, folder).select("seq", transform_uuid(F.col("value"), FORMAT_HEX).alias("_u"))
    return made.select("seq", "_u.transformed", "_u.is_valid")


@query(
    "f10_recommendations",
    f"""WITH {SQL_TRANSFORMED}, n AS (SELECT count(*) AS total, count(*) FILTER (format = 'uuid_standard') AS uuid_standard,
      count(*) FILTER (format = 'hex_32') AS hex_32, count(*) FILTER (format = 'invalid') AS invalid FROM t)
    SELECT *, printf('Found %d hex32 UUIDs (%.1f%%) - recommend transformation to standard format', hex_32, hex_32 / total * 100) AS hex_advice,
      printf('Found %d invalid UUIDs (%.1f%%) - require manual review', invalid, invalid / total * 100) AS invalid_advice,
      CAST(NULL AS VARCHAR) AS standard_advice, round(CAST(CASE WHEN total <= 100 THEN total * 0.1 ELSE total * 0.05 END AS DOUBLE), 6) AS estimated_ms,
      CASE WHEN total <= 100 THEN total WHEN total <= 1000 THEN 100 ELSE 500 END AS batch_size FROM n""",
)
def f10(spark, folder):
    found = identifier_report.recommendations(identifiers(spark, folder), "value")
    return found.withColumn("estimated_ms", F.round("estimated_ms", 6))


@query("f10_invalid_sample", f"WITH {SQL_TRANSFORMED} SELECT seq, value FROM t WHERE format = 'invalid' ORDER BY seq LIMIT 10")
def f10_sample(spark, folder):
    return identifier_report.invalid_sample(identifiers(spark, folder), "value", "seq")


@query(
    "a9_batch_transform",
    f"WITH {SQL_TRANSFORMED} SELECT min(seq) AS first_seen, value AS original, transformed, format FROM t GROUP BY value, transformed, format",
)
def a9(spark, folder):
    made = identifier_report.transform_batch(identifiers(spark, folder), "value", "seq")
    return made.select("first_seen", "original", "transformed", "format")


@query(
    "a9_batch_statistics",
    f"WITH {SQL_TRANSFORMED}, d AS (SELECT DISTINCT value, format FROM t) SELECT count(*) AS total, count(*) FILTER (format <> 'invalid') AS successful, "
    "count(*) FILTER (format = 'invalid') AS failed, count(*) FILTER (format = 'uuid_standard') AS uuid_standard, count(*) FILTER (format = 'hex_32') AS hex_32, "
    "count(*) FILTER (format = 'invalid') AS invalid FROM d",
)
def a9_stats(spark, folder):
    return identifier_report.batch_statistics(identifier_report.transform_batch(identifiers(spark, folder), "value", "seq"))


@query(
    "f11_scan_columns",
    f"WITH {SQL_TRANSFORMED} SELECT 'value' AS \"column\", format, count(*) AS values FROM t WHERE format <> 'invalid' GROUP BY format "
    "UNION ALL SELECT 'digest', 'hex_32', count(*) FROM t",
)
def f11(spark, folder):
    wide = identifiers(spark, folder).withColumn("digest", F.md5(F.col("value").cast("binary"))).withColumn("note", F.lit("none"))
    return identifier_report.scan_text_columns(wide)


@query(
    "f8_uuid_validation",
    f"WITH {SQL_TRANSFORMED} SELECT seq, regexp_matches(replace(value, '-', ''), '^[0-9a-fA-F]{{32}}$') AS dashed, regexp_matches(value, '^[0-9a-fA-F]{{32}}$') AS hex FROM t",
)
def f8(spark, folder):
    found = identifiers(spark, folder)
    return found.select("seq", is_valid_uuid(F.col("value")).alias("dashed"), is_valid_uuid(F.col("value"), FORMAT_HEX).alias("hex"))
