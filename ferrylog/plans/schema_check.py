"""Does a source set fit the target's fields: findings, scores, advice."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.functions.payloads import (
    BIGINT,
    BOOLEAN,
    DATETIME_ISO,
    DATETIME_UNIX,
    FLOAT,
    INTEGER,
    JSON,
    LARGEST_INT,
    STRING,
    UUID,
    json_value_type,
    text_type,
)

# fixed values: fields the target expects, advice texts, names the source uses for two fields
USER_FIELDS = {
    "username": STRING,
    "status": STRING,
    "used_traffic": BIGINT,
    "data_limit": BIGINT,
    "expire": DATETIME_UNIX,
    "created_at": DATETIME_ISO,
    "edit_at": DATETIME_ISO,
    "note": STRING,
    "sub_revoked_at": DATETIME_ISO,
    "sub_updated_at": DATETIME_ISO,
    "sub_last_user_agent": STRING,
    "online_at": DATETIME_ISO,
    "data_limit_reset_strategy": STRING,
    "admin_id": INTEGER,
    "on_hold_timeout": DATETIME_ISO,
    "on_hold_expire_duration": INTEGER,
    "auto_delete_in_days": INTEGER,
    "last_status_change": DATETIME_ISO,
}
ADMIN_FIELDS = {
    "username": STRING,
    "hashed_password": STRING,
    "is_sudo": BOOLEAN,
    "created_at": DATETIME_ISO,
    "password_reset_at": DATETIME_ISO,
    "telegram_id": BIGINT,
    "discord_webhook": STRING,
    "users_usage": BIGINT,
}
CONVERSION = "datetime_to_unix_timestamp"
NAMED_ADVICE = "Convert %s from ISO datetime to Unix timestamp using %s"
NUMBER_ADVICE = "Convert %s from string to integer with validation"
UNIX_ADVICE = "Convert %s from ISO datetime to Unix timestamp"
REVIEW_ADVICE = "Review and fix %s type conversion: %s -> %s"
RENAMED = {"expire_date": "expire", "updated_at": "edit_at"}


def value_type(df: DataFrame, name: str) -> Column:
    """Field type of each value of a typed column; NULL counts as a string."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType):
        found = F.lit(BOOLEAN)
    elif isinstance(kind, T.IntegralType):
        found = F.when(col > LARGEST_INT, BIGINT).otherwise(INTEGER)
    elif isinstance(kind, T.NumericType):
        found = F.lit(FLOAT)
    elif isinstance(kind, T.StringType):
        return text_type(col)
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        found = F.lit(JSON)
    elif isinstance(kind, T.VariantType):
        return json_value_type(F.to_json(col))
    else:
        found = F.lit(STRING)
    return F.when(col.isNull(), F.lit(STRING)).otherwise(found)


def field_types(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """(field, value_type, sample) for every value: one pass, one row per field of every row."""
    renames = RENAMED if renames is None else renames
    cells = F.array(
        *[
            F.struct(
                F.lit(renames.get(c, c)).alias("field"),
                value_type(df, c).alias("value_type"),
                (F.to_json(F.col(c)) if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(c).cast("string")).alias("sample"),
            )
            for c in df.columns
        ]
    )
    return df.select(F.inline(cells))


def _possible_types(kind: T.DataType) -> tuple[str, ...]:
    """The field types that values of a column can have; nulls count as strings."""
    if isinstance(kind, T.BooleanType):
        return (BOOLEAN, STRING)
    if isinstance(kind, T.IntegralType):
        return (INTEGER, BIGINT, STRING)
    if isinstance(kind, T.NumericType):
        return (FLOAT, STRING)
    if isinstance(kind, T.StringType):
        return (STRING, DATETIME_ISO, UUID)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return (JSON, STRING)
    if isinstance(kind, T.VariantType):
        return (STRING, INTEGER, BIGINT, FLOAT, BOOLEAN, DATETIME_ISO, UUID, JSON)
    return (STRING,)


#: Columns whose types are counted by one aggregate; many more would make generated code too long to compile.
SLICE = 4


def _seen_types(df: DataFrame, renames: dict[str, str] | None) -> DataFrame:
    """``field, value_type, values, known, sample`` over all rows: conditional counts, no row per value; each slice reads its own columns."""
    renames = RENAMED if renames is None else renames
    slices = [_seen_in(df.select(*df.columns[i : i + SLICE]), renames) for i in range(0, len(df.columns), SLICE)]
    each = functools.reduce(DataFrame.unionByName, slices)
    return each.groupBy("field", "value_type").agg(F.sum("values").alias("values"), F.sum("known").alias("known"), F.min("sample").alias("sample"))


def _seen_in(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    nested = (T.StructType, T.ArrayType, T.MapType)
    cells = df.select(
        *[value_type(df, c).alias(f"t{i}") for i, c in enumerate(df.columns)],
        *[(F.to_json(c) if isinstance(df.schema[c].dataType, nested) else F.col(c).cast("string")).alias(f"s{i}") for i, c in enumerate(df.columns)],
    )
    found = []
    for i, c in enumerate(df.columns):
        for t in _possible_types(df.schema[c].dataType):
            is_type = F.col(f"t{i}") == t
            found.append((renames.get(c, c), t, F.count_if(is_type), F.count(F.when(is_type, F.col(f"s{i}"))), F.min(F.when(is_type, F.col(f"s{i}")))))
    names = ("values", "known", "sample")
    folded = cells.agg(*[x.alias(f"{n}{k}") for k, row in enumerate(found) for n, x in zip(names, row[2:], strict=True)])
    rows = [F.struct(F.lit(f).alias("field"), F.lit(t).alias("value_type"), *[F.col(f"{n}{k}").alias(n) for n in names]) for k, (f, t, *_) in enumerate(found)]
    return folded.select(F.inline(F.array(*rows))).filter("values > 0")


def type_profile(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """How many values of each type every field holds, over all rows."""
    return _seen_types(df, renames).select("field", "value_type", "values")


def _first_types(df: DataFrame, order: list[str], renames: dict[str, str] | None) -> DataFrame:
    return field_types(df.orderBy(*order).limit(1).drop(*[c for c in order if c == "seq"]), renames)


def _main_types(df: DataFrame, renames: dict[str, str] | None) -> DataFrame:
    # nulls are typed as strings, so a field is a string only when nothing else was seen
    ranked = F.struct(F.col("known").alias("_n"), "value_type", "sample")
    return _seen_types(df.drop("seq"), renames).groupBy("field").agg(F.max(ranked).alias("_t")).select("field", "_t.value_type", "_t.sample")


def compare_fields(
    df: DataFrame,
    expected: dict[str, str],
    order: list[str] | None = None,
    renames: dict[str, str] | None = None,
) -> DataFrame:
    """(field, finding, source_type, target_type, severity, conversion, sample) for every field.

    With ``order`` the first record decides, without it the commonest type over all rows.
    Findings are compatible, incompatible, missing and extra.
    """
    found = _first_types(df, order, renames) if order else _main_types(df, renames)
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(expected.items()), "field string, target_type string")
    pair = found.withColumnRenamed("value_type", "source_type").join(F.broadcast(wanted), "field", "left")
    absent = wanted.join(found.select("field"), "field", "left_anti")
    pair = pair.unionByName(absent, allowMissingColumns=True)
    source, target = F.col("source_type"), F.col("target_type")
    finding = (
        F.when(source.isNull(), "missing")
        .when(target.isNull(), "extra")
        .when(source == target, "compatible")
        .otherwise("incompatible")
    )
    to_unix = (F.col("field") == "expire") & (source == DATETIME_ISO) & (target == DATETIME_UNIX)
    odd = finding == "incompatible"
    return pair.select(
        "field",
        finding.alias("finding"),
        "source_type",
        "target_type",
        F.when(odd, F.when(to_unix, "high").otherwise("medium")).alias("severity"),
        F.when(odd & to_unix, CONVERSION).alias("conversion"),
        F.when(odd, F.col("sample")).alias("sample"),
    )


def compatibility_score(findings: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Counts per finding and compatible / expected fields; no rows at all score 1."""
    counted = findings.agg(
        *[F.count_if(F.col("finding") == k).alias(k) for k in ("compatible", "incompatible", "missing", "extra")]
    )
    empty = (F.col("compatible") + F.col("incompatible") + F.col("extra")) == 0
    score = F.when(empty, F.lit(1.0)).otherwise(F.col("compatible") / F.lit(float(len(expected))))
    missing = F.when(empty, F.lit(0).cast("long")).otherwise(F.col("missing"))
    return counted.withColumns({"score": score, "missing": missing})


def conversion_advice(findings: DataFrame) -> DataFrame:
    """Advice text per incompatible field."""
    name, source, target = F.col("field"), F.col("source_type"), F.col("target_type")
    text = (
        F.when(
            F.col("conversion").isNotNull(),
            F.format_string(NAMED_ADVICE, name, F.col("conversion")),
        )
        .when((source == STRING) & (target == INTEGER), F.format_string(NUMBER_ADVICE, name))
        .when((source == DATETIME_ISO) & (target == DATETIME_UNIX), F.format_string(UNIX_ADVICE, name))
        .otherwise(F.format_string(REVIEW_ADVICE, name, source, target))
    )
    return findings.filter(F.col("finding") == "incompatible").select("field", text.alias("advice"))


def compatibility_report(users: DataFrame, admins: DataFrame) -> DataFrame:
    """Both scores as (section, metric, value) rows."""
    parts = []
    for section, scored in (("users", users), ("admins", admins)):
        metrics = F.array(
            *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("score", "compatible", "incompatible", "missing", "extra")]
        )
        parts.append(scored.select(F.lit(section).alias("section"), F.inline(metrics)))
    return parts[0].unionByName(parts[1])
