"""Checks after a transfer: counts, identifiers, keys and references."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylog.plans.accounts import has_text, user_proxies

SAMPLE = 15  # fixed value: mismatches shown in a report


def count_entities(target: DataFrame, key: str = "id") -> DataFrame:
    return target.agg(F.count(key).alias("rows"))


def expected_proxies(users: DataFrame) -> DataFrame:
    """(username, type, uuid) each source user should have.

    Of repeated names the last row that yields any proxy speaks for the user.
    """
    own = users.filter(has_text(F.col("username"))).select("username", "seq", user_proxies().alias("_p")).filter(F.size("_p") > 0)
    last = own.groupBy("username").agg(F.max_by("_p", "seq").alias("_p"))
    return last.select("username", F.inline("_p"))


def count_validation(users: DataFrame, admins: DataFrame, target: dict[str, DataFrame]) -> DataFrame:
    """Source rows, distinct names and target rows per entity, with MATCH or MISMATCH.

    Source counts are raw; distinct names stand beside them since repeats are not moved.
    """
    named = has_text(F.col("username"))

    def line(entity: str, df: DataFrame, rows, distinct) -> DataFrame:
        return df.agg(rows.cast("long").alias("source_rows"), distinct.alias("source_distinct")).withColumn("entity", F.lit(entity))

    one, name = F.count(F.lit(1)), F.count_distinct(F.when(named, F.col("username")))
    made = F.when(named, F.size(user_proxies())).otherwise(F.lit(0))
    source = (
        line("users", users, one, name)
        .unionByName(line("admins", admins, one, name))
        .unionByName(line("proxies", users, F.coalesce(F.sum(made), F.lit(0)), F.count_distinct(F.when(made > 0, F.col("username")))))
    )
    stored = None
    for entity in ("users", "admins", "proxies"):
        part = target[entity].agg(F.count("id").alias("target_rows")).withColumn("entity", F.lit(entity))
        stored = part if stored is None else stored.unionByName(part)
    status = F.when(F.col("source_rows") == F.col("target_rows"), "MATCH").otherwise("MISMATCH")
    return source.join(stored, "entity").withColumn("status", status).select("entity", "source_rows", "source_distinct", "target_rows", "status")


def uuid_validation(users: DataFrame, target_users: DataFrame, target_proxies: DataFrame) -> DataFrame:
    """Per source user and protocol: ok, user_missing, proxy_missing or uuid_mismatch, with detail text.

    Both sides are brought to one row per user and type before they meet.
    """
    expected = expected_proxies(users)
    known = target_users.select("username", F.col("id").alias("user_id"))
    uuid = F.get_json_object("settings", "$.id")
    stored = (
        target_proxies.withColumn("_uuid", uuid)
        .filter(has_text(F.col("_uuid")))
        .groupBy("user_id", F.upper("type").alias("type"))
        .agg(F.max_by("_uuid", "id").alias("target_uuid"))
    )
    judged = expected.join(known, "username", "left").join(stored, ["user_id", "type"], "left")
    name, kind, want, have = F.col("username"), F.col("type"), F.col("uuid"), F.col("target_uuid")
    status = (
        F.when(F.col("user_id").isNull(), "user_missing")
        .when(have.isNull(), "proxy_missing")
        .when(have != want, "uuid_mismatch")
        .otherwise("ok")
    )
    detail = (
        F.when(F.col("user_id").isNull(), F.format_string("User '%s': not found in target", name))
        .when(have.isNull(), F.format_string("User '%s', protocol '%s': proxy missing in target (expected %s)", name, kind, want))
        .when(have != want, F.format_string("User '%s', protocol '%s': UUID mismatch, source %s, target %s", name, kind, want, have))
    )
    return judged.select("username", "type", want.alias("source_uuid"), "target_uuid", status.alias("status"), detail.alias("detail"))


def failure_sample(validated: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The first mismatches by name: a report of ``rows`` lines."""
    return validated.filter(F.col("status") != "ok").orderBy("username", "type").limit(rows)


def all_valid(counts: DataFrame, uuids: DataFrame) -> DataFrame:
    """Two verdicts and their conjunction."""
    a = counts.agg((F.count_if(F.col("status") != "MATCH") == 0).alias("ok")).select(F.lit("counts").alias("validation"), "ok")
    b = uuids.agg((F.count_if(F.col("status") != "ok") == 0).alias("ok")).select(F.lit("uuids").alias("validation"), "ok")
    both = a.unionByName(b)
    return both.unionByName(both.agg(F.bool_and("ok").alias("ok")).select(F.lit("all").alias("validation"), "ok"))


def _own_rules(df: DataFrame, table: str, unique: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Repeated values of unique columns, each counted in its own type, and missing ones of required columns, all in one aggregate."""
    lines = []
    for c in unique:
        counted = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        lines.append(counted.agg(F.count_if(F.col("_n") > 1).alias("violations")).select(F.lit(table).alias("table"), F.lit(f"unique {c}").alias("rule"), "violations"))
    if required:
        absent = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(required)])
        told = [F.struct(F.lit(table).alias("table"), F.lit(f"{c} not null").alias("rule"), F.col(f"_{i}").alias("violations")) for i, c in enumerate(required)]
        lines.append(absent.select(F.inline(F.array(*told))))
    return functools.reduce(DataFrame.unionByName, lines)


def _dangling(child: DataFrame, column: str, parent: DataFrame, table: str, rule: str) -> DataFrame:
    # counted per value before the join: one admin may own most users
    used = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    lost = used.join(parent.select(F.col("id").alias(column)), column, "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("violations")).select(
        F.lit(table).alias("table"), F.lit(rule).alias("rule"), "violations"
    )


def key_rules(users: DataFrame, proxies: DataFrame, admins: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One line per rule with the number of keys or rows that break it."""
    lines = [
        _own_rules(users, "users", ["username"], ["username"]),
        _own_rules(admins, "admins", ["username", "telegram_id"], ["username"]),
        _dangling(proxies, "user_id", users, "proxies", "user_id in users"),
        _dangling(users, "admin_id", admins, "users", "admin_id in admins"),
    ]
    if events is not None:
        lines.append(_own_rules(events, "events", ["event_id"], []))
    out = lines[0]
    for nxt in lines[1:]:
        out = out.unionByName(nxt)
    return out
