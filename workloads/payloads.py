"""The fields of payloads at every depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrylog.plans import payload_check
from workloads.adapters import SQL_ENVELOPES, envelopes, raw_events
from workloads.registry import query

SQL_NESTED = """nested AS (
  SELECT event_type, CASE WHEN event_id % 50 = 7 THEN 'broken {' ELSE concat('{"k": ', props->>'$.k', ', "deep": {"kind": "', event_type, '", "odd": ', event_id % 2 = 1, ', "none": null}, ',
    '"list": [{"x": ', user_id, '}, {"x": ', CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN '"text"' ELSE '1' END, '}], "mixed": ',
    CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN CASE WHEN event_type = 'view' THEN '{"y": 2}' ELSE '2.5' END ELSE 'null' END, '}') END AS payload FROM events
), seen AS (
  SELECT event_type, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path,
    CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'bigint' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'decimal' WHEN 'ARRAY' THEN 'list' WHEN 'NULL' THEN 'void' ELSE lower(t.type) END AS kind
  FROM nested, json_tree(nested.payload) t WHERE json_valid(payload)
), kinds AS (
  SELECT event_type, path, list_sort(list(DISTINCT kind) FILTER (kind <> 'void')) AS found FROM seen GROUP BY ALL
), paths AS (
  SELECT event_type, path, CASE WHEN coalesce(len(found), 0) = 0 THEN 'void' WHEN len(found) = 1 THEN found[1] WHEN found = ['bigint', 'decimal'] THEN 'decimal' ELSE 'conflict' END AS type FROM kinds k
  WHERE NOT EXISTS (SELECT 1 FROM kinds p WHERE p.event_type = k.event_type AND len(p.found) > 1 AND p.found <> ['bigint', 'decimal'] AND (starts_with(k.path, p.path || '.') OR starts_with(k.path, p.path || '[')))
)"""


def nested(spark, folder):
    """``props`` inside deeper payloads: lists of objects, nulls, fields of several types in some event types, broken texts."""
    number, kind = F.col("event_id"), F.col("event_type")
    part = lambda *pieces: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])
    x = F.when((kind == "error") & (number % 5 == 0), '"text"').otherwise("1")
    mixed = F.when(number % 3 == 0, "1").when(number % 3 == 1, F.when(kind == "view", '{"y": 2}').otherwise("2.5")).otherwise("null")
    text = part(
        '{"k": ', F.get_json_object("props", "$.k"), ', "deep": {"kind": "', kind, '", "odd": ', number % 2 == 1, ', "none": null}, "list": [{"x": ', F.col("user_id"),
        '}, {"x": ', x, '}], "mixed": ', mixed, "}",
    )
    return raw_events(spark, folder).select("event_type", F.when(number % 50 == 7, "broken {").otherwise(text).alias("payload"))


@query("f12_nested_paths", f"WITH {SQL_NESTED} SELECT event_type, path, type FROM paths")
def f12_nested(spark, folder):
    return payload_check.payload_paths(nested(spark, folder), "payload", ["event_type"])


@query(
    "f12_nested_counts",
    f"WITH {SQL_NESTED} SELECT event_type, count(*) AS payloads, count(*) FILTER (NOT json_valid(payload)) AS broken FROM nested GROUP BY event_type",
)
def f12_counts(spark, folder):
    return payload_check.payload_schemas(nested(spark, folder), "payload", ["event_type"]).drop("schema")


EXPECTED = {"$": "object", "$.k": "bigint", "$.deep": "object", "$.deep.kind": "bigint", "$.deep.none": "string", "$.list": "list", "$.list[*].x": "decimal", "$.mixed": "decimal", "$.gone": "string"}
_VALUES = ", ".join(f"('{p}', '{t}')" for p, t in EXPECTED.items())


@query(
    "f14_nested_findings",
    f"""WITH {SQL_NESTED}, wanted AS (SELECT * FROM (SELECT DISTINCT event_type FROM paths), (VALUES {_VALUES}) v(path, target_type))
SELECT event_type, path, CASE WHEN type IS NULL THEN 'missing' WHEN target_type IS NULL THEN 'extra' WHEN type = 'conflict' THEN 'conflict'
  WHEN type IN (target_type, 'void') OR (type = 'bigint' AND target_type = 'decimal') THEN 'compatible' ELSE 'incompatible' END AS finding, type AS source_type, target_type
FROM paths FULL JOIN wanted USING (event_type, path)""",
)
def f14_nested(spark, folder):
    paths = payload_check.payload_paths(nested(spark, folder), "payload", ["event_type"])
    return payload_check.compare_paths(paths, EXPECTED, ["event_type"])


@query(
    "f12_envelope_paths",
    f"""WITH {SQL_ENVELOPES}, fields(event_type, path, type, odd) AS (VALUES
  ('data.extracted', '$.record_count', 'bigint', FALSE), ('data.transformed', '$.output_count', 'bigint', FALSE), ('data.imported', '$.imported_count', 'bigint', FALSE),
  ('data.validated', '$.valid_records', 'bigint', FALSE), ('data.validated', '$.invalid_records', 'bigint', FALSE), ('data.validated', '$.validation_errors', 'list', TRUE), ('data.validated', '$.validation_errors[*]', 'string', TRUE))
SELECT DISTINCT event_type, path, type FROM envelopes JOIN fields USING (event_type) WHERE NOT odd OR k % 2 = 1
UNION ALL SELECT DISTINCT event_type, '$', 'object' FROM envelopes WHERE event_type LIKE 'data.%'""",
)
def f12_envelopes(spark, folder):
    data = envelopes(spark, folder).filter(F.col("event_type").startswith("data."))
    return payload_check.payload_paths(data, "event_data", ["event_type"])
