"""Questions to the event table: selections, statistics, summaries, sequence checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylog.operators.ordering import TARGET_ROWS, with_seq
from ferrylog.plans.event_model import EVENT_ORDER


def _between(events: DataFrame, column: str, low, high) -> DataFrame:
    if low is not None:
        events = events.filter(F.col(column) >= F.lit(low))
    if high is not None:
        events = events.filter(F.col(column) <= F.lit(high))
    return events


def by_aggregate(events: DataFrame, aggregate_id: str, from_version: int | None = None, to_version: int | None = None) -> DataFrame:
    chosen = events.filter(F.col("aggregate_id") == aggregate_id)
    return _between(chosen, "event_version", from_version, to_version).orderBy("event_version", *EVENT_ORDER)


def by_types(events: DataFrame, types: Iterable[str], start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Events of the given types in one pass, by time."""
    chosen = events.filter(F.col("event_type").isin(*dict.fromkeys(types)))
    return _between(chosen, "timestamp", start, end).orderBy(*EVENT_ORDER)


def by_correlation(events: DataFrame, correlation_id: str) -> DataFrame:
    return events.filter(F.col("correlation_id") == correlation_id).orderBy(*EVENT_ORDER)


def all_events(events: DataFrame, start: datetime | None = None, end: datetime | None = None, limit: int | None = None) -> DataFrame:
    chosen = _between(events, "timestamp", start, end).orderBy(*EVENT_ORDER)
    return chosen.limit(limit) if limit else chosen


def query_events(
    events: DataFrame,
    aggregate_id: str | None = None,
    correlation_id: str | None = None,
    event_types: Sequence[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    from_version: int | None = None,
    to_version: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One selection: aggregate before correlation before types before everything.

    The time range only narrows the last two.
    """
    if aggregate_id:
        chosen = by_aggregate(events, aggregate_id, from_version, to_version)
    elif correlation_id:
        chosen = by_correlation(events, correlation_id)
    elif event_types:
        chosen = by_types(events, event_types, start, end)
    else:
        chosen = all_events(events, start, end)
    return chosen.limit(limit) if limit else chosen


def event_lines(events: DataFrame, start: datetime | None = None, end: datetime | None = None, types: Sequence[str] = ()) -> DataFrame:
    """Six fields per event as one JSON line, for any sink that takes text."""
    chosen = _between(events, "timestamp", start, end)
    if types:
        chosen = chosen.filter(F.col("event_type").isin(*types))
    fields = F.struct(
        "event_id",
        "event_type",
        "aggregate_id",
        "aggregate_type",
        "timestamp",
        F.try_parse_json("event_data").alias("data"),
    )
    return chosen.select("event_id", F.to_json(fields, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))


def event_statistics(events: DataFrame) -> DataFrame:
    """Long form (section, name, events, latest): total, per event type, per aggregate type in one pass."""
    fine = events.groupBy("event_type", "aggregate_type").agg(
        F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("latest")
    )
    sections = F.explode(
        F.array(
            F.struct(F.lit("total").alias("section"), F.lit("all").alias("name")),
            F.struct(F.lit("event_type").alias("section"), F.col("event_type").alias("name")),
            F.struct(F.lit("aggregate_type").alias("section"), F.col("aggregate_type").alias("name")),
        )
    )
    counted = fine.select(sections.alias("_s"), "events", "latest").select("_s.*", "events", "latest")
    return counted.groupBy("section", "name").agg(F.sum("events").alias("events"), F.max("latest").alias("latest"))


def event_summary(events: DataFrame) -> DataFrame:
    """Count, first and last per event type and aggregate type; most frequent first."""
    return (
        events.groupBy("event_type", "aggregate_type")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.min("timestamp").alias("first_event"),
            F.max("timestamp").alias("last_event"),
        )
        .orderBy(F.desc("event_count"), "event_type", "aggregate_type")
    )


def run_overview(statistics: DataFrame, events: DataFrame) -> DataFrame:
    """Run statistics with duration and the number of events per run, newest first.

    Events are counted per aggregate before the join, so a hot aggregate joins as one row.
    """
    counted = events.groupBy(F.col("aggregate_id").alias("run_id")).agg(F.count("event_id").alias("total_events"))
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1_000_000)
    return (
        statistics.join(counted, "run_id", "left")
        .withColumn("duration_seconds", seconds)
        .withColumn("total_events", F.coalesce("total_events", F.lit(0).cast("long")))
        .orderBy(F.desc("started_at"), "run_id")
    )


def sequence_differences(
    events: DataFrame,
    expected: Sequence[str],
    order: Sequence[str] = ("event_version", *EVENT_ORDER),
    key: str = "aggregate_id",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """(key, position, expected, actual) wherever an aggregate's event types differ from the list."""
    wanted, length = F.lit(list(expected)), len(expected)
    placed = with_seq(events.select(key, "event_type", *[c for c in order if c != key]), order, [key], "_n", target_rows)
    position: Column = F.col("_n") - 1
    want = F.when(position < length, F.get(wanted, position.cast("int")))
    wrong = placed.select(key, position.alias("position"), want.alias("expected"), F.col("event_type").alias("actual"))
    wrong = wrong.filter(~F.col("expected").eqNullSafe(F.col("actual")))
    short = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < length)
    absent = short.select(key, F.explode(F.sequence(F.col("_n"), F.lit(length - 1).cast("long"))).alias("position"))
    absent = absent.select(
        key, "position", F.get(wanted, F.col("position").cast("int")).alias("expected"), F.lit(None).cast("string").alias("actual")
    )
    return wrong.unionByName(absent)


def sequence_verdicts(events: DataFrame, expected: Sequence[str], **options) -> DataFrame:
    """Per aggregate: is the sequence as expected, and in how many places not."""
    key = options.get("key", "aggregate_id")
    found = sequence_differences(events, expected, **options).groupBy(key).agg(F.count(F.lit(1)).alias("differences"))
    return (
        events.select(key).distinct().join(found, key, "left")
        .withColumn("differences", F.coalesce("differences", F.lit(0).cast("long")))
        .withColumn("is_valid", F.col("differences") == 0)
    )
