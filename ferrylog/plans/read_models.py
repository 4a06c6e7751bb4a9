"""Read models folded from events: runs, users, snapshots, replay, incremental projections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylog.functions.payloads import payload_long, payload_text
from ferrylog.operators.skew import lookup_join
from ferrylog.plans.event_model import ADMIN_MOVED, EVENT_ORDER, RUN, RUN_COMPLETED, RUN_FAILED, RUN_ID, RUN_STARTED, USER_MOVED, known_type
from ferrylog.session import materialise

# fixed values: which event adds which payload counter to its run
COUNTERS = {
    "extracted_count": ("data.extracted", "record_count"),
    "transformed_count": ("data.transformed", "output_count"),
    "validated_count": ("data.validated", "valid_records"),
    "imported_count": ("data.imported", "imported_count"),
}
HEADCOUNTS = {"user_count": USER_MOVED, "admin_count": ADMIN_MOVED}
STARTED, COMPLETED, FAILED = RUN_STARTED, RUN_COMPLETED, RUN_FAILED
ROLLBACKS = ("rollback.initiated", "rollback.completed")
CORRELATED = (*[t for t, _ in COUNTERS.values()], *HEADCOUNTS.values())


def _place(order: Sequence[str]) -> Column:
    return F.struct(*order)


#: Payload fields that the model looks at, all as text; a payload is parsed for them once.
PAYLOAD_FIELDS = (
    "source_config", "target_config", "record_count", "output_count", "valid_records", "invalid_records", "validation_errors", "imported_count",
    "duration_seconds", "statistics", "error_message", "error_details", RUN_ID, "reason", "success",
)


def parsed(events: DataFrame) -> DataFrame:
    """Events with ``_p``, their payload's fields; generated, so that the text is parsed once however many fields are used."""
    fields = F.from_json("event_data", ", ".join(f"{f} string" for f in PAYLOAD_FIELDS))
    return events.select("*", F.inline(F.array(F.struct(fields.alias("_p")))))


def _number(field: str) -> Column:
    """A counter in a parsed payload; absent or not a number counts as 0."""
    return F.coalesce(F.col(f"_p.{field}").try_cast("long"), F.lit(0).cast("long"))


def latest_starts(events: DataFrame, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """The last start event of every run; whatever came before it no longer counts."""
    start = F.struct(
        F.col("event_id"),
        F.col("correlation_id"),
        F.col("timestamp").alias("started_at"),
        F.col("_p.source_config").alias("source_config"),
        F.col("_p.target_config").alias("target_config"),
        _place(order).alias("_from"),
    )
    starts = parsed(events.filter(F.col("event_type") == STARTED))
    return (
        starts.groupBy(F.col("aggregate_id").alias("run_id"))
        .agg(F.max_by(start, _place(order)).alias("_s"))
        .select("run_id", "_s.*")
    )


def run_keys(starts: DataFrame) -> DataFrame:
    """``run_id, _from, rank, link_key``: the ids under which events may point at a run, by preference.

    A correlation id may name the run, its start event, or the start's own correlation id.
    """
    candidates = F.array(
        F.struct(F.lit(1).alias("rank"), F.col("run_id").alias("link_key")),
        F.struct(F.lit(2).alias("rank"), F.col("event_id").alias("link_key")),
        F.struct(F.lit(3).alias("rank"), F.col("correlation_id").alias("link_key")),
    )
    return starts.select("run_id", "_from", F.inline(candidates)).filter(F.col("link_key").isNotNull())


def start_keys(events: DataFrame) -> DataFrame:
    """Start events under each id that leads to them, with ``run_id`` and ``link_key``."""
    starts = events.filter(F.col("event_type") == STARTED)
    keys = F.array_distinct(F.array_compact(F.array("aggregate_id", "event_id", "correlation_id")))
    return starts.select("*", F.col("aggregate_id").alias("run_id"), F.explode(keys).alias("link_key"))


def run_links(starts: DataFrame) -> DataFrame:
    """(link_key, run_id, _from): the run that a correlation id names.

    Of several runs under one key, the one it names best has it, then the one of the smallest id.
    """
    best = F.min_by(F.struct("run_id", "_from"), F.struct("rank", "run_id"))
    return run_keys(starts).groupBy("link_key").agg(best.alias("_m")).select("link_key", "_m.*")


def pointing_events(events: DataFrame) -> DataFrame:
    """Events that point at a run, with the ``way`` and ``link_key`` they point by; of payloads only those of rollbacks are parsed.

    Counted events point by correlation id, endings by aggregate id, rollbacks by the run id in their payload.
    """
    kind = F.col("event_type")
    concerned = kind.isin(*CORRELATED, COMPLETED, FAILED, *ROLLBACKS)

    def way(name: str, key: Column) -> Column:
        return F.array(F.struct(F.lit(name).alias("way"), key.alias("link_key")))

    # generated rows, since a plain column would be inlined into every condition on it
    ways = (
        F.when(kind.isin(*CORRELATED), way("link", F.col("correlation_id")))
        .when(kind.isin(COMPLETED, FAILED), way("own", F.col("aggregate_id")))
        .when(kind.isin(*ROLLBACKS), way("own", F.from_json("event_data", f"{RUN_ID} string")[RUN_ID]))
    )
    return events.filter(concerned).select("*", F.inline(ways)).filter(F.col("link_key").isNotNull())


#: The columns of pointing events that a fold looks at.
POINTING = ("way", "link_key", "event_id", "event_type", "aggregate_id", "timestamp", "event_data")


def link_table(starts: DataFrame) -> DataFrame:
    """``way, link_key, run_id, _from`` for both ways to point."""
    own = starts.select(F.lit("own").alias("way"), F.col("run_id").alias("link_key"), "run_id", "_from")
    return run_links(starts).select(F.lit("link").alias("way"), "link_key", "run_id", "_from").unionByName(own)


def _linked(pointing: DataFrame, links: DataFrame, order: Sequence[str]) -> DataFrame:
    # both sides shuffle on the key, so adaptive skew joins can split a correlation id shared by very many events;
    # links are one row per key, so events need not be sorted to meet them
    found = pointing.join(links.hint("shuffle_hash"), ["way", "link_key"])
    return found.filter(_place(order) > F.col("_from")).drop("way", "link_key", "_from")


def linked_events(events: DataFrame, starts: DataFrame, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """Events that belong to a run and come after its latest start, with ``run_id``."""
    return _linked(pointing_events(events), link_table(starts), order)


#: What a run's state adds up, and what it keeps of the last event of a kind.
COUNTED = (*COUNTERS, *HEADCOUNTS, "error_count")
KEPT = ("_ended", "_done", "_failed", "_undo", "_undone")


def accumulated(order: Sequence[str] = EVENT_ORDER) -> list[Column]:
    """Aggregates over pointing events: sums, and the values of the last event of each kind with its ``place`` in the order."""
    kind, when = F.col("event_type"), _place(order)

    def last(condition: Column, **values: Column) -> Column:
        """The named values of the last event for which the condition holds."""
        return F.max_by(F.struct(when.alias("place"), *[v.alias(n) for n, v in values.items()]), F.when(condition, when))

    text = lambda field: F.col(f"_p.{field}")
    errors = F.coalesce(F.json_array_length(text("validation_errors")), F.lit(0))
    return [
        *[F.sum(F.when(kind == t, _number(f)).otherwise(F.lit(0))).alias(n) for n, (t, f) in COUNTERS.items()],
        *[F.count_if(kind == t).alias(n) for n, t in HEADCOUNTS.items()],
        F.sum(F.when((kind == "data.validated") & (_number("invalid_records") > 0), errors).otherwise(F.lit(0))).cast("long").alias("error_count"),
        last(kind.isin(COMPLETED, FAILED), status=F.when(kind == COMPLETED, "completed").otherwise("failed")).alias("_ended"),
        last(kind == COMPLETED, at=F.col("timestamp"), seconds=text("duration_seconds").try_cast("double"), statistics=text("statistics")).alias("_done"),
        last(kind == FAILED, at=F.col("timestamp"), message=F.coalesce(text("error_message"), F.lit("")), details=text("error_details")).alias("_failed"),
        last(kind == ROLLBACKS[0], at=F.col("timestamp"), id=F.col("aggregate_id"), reason=F.coalesce(text("reason"), F.lit(""))).alias("_undo"),
        last(kind == ROLLBACKS[1], at=F.col("timestamp"), success=F.coalesce(text("success").try_cast("boolean"), F.lit(False))).alias("_undone"),
    ]


def merged() -> list[Column]:
    """Aggregates that join what :func:`accumulated` made of parts of the events."""
    return [*[F.sum(c).alias(c) for c in COUNTED], *[F.max_by(c, f"{c}.place").alias(c) for c in KEPT]]


def model_rows(starts: DataFrame, folded: DataFrame) -> DataFrame:
    """The read model's rows: runs with their latest start and, by ``run_id``, what came after it."""
    model = starts.select("run_id", "started_at", "source_config", "target_config").join(folded, "run_id", "left")
    return model.select(
        "run_id", "started_at", "source_config", "target_config",
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in COUNTED],
        F.col("_done.at").alias("completed_at"), F.col("_failed.at").alias("failed_at"),
        F.col("_done.seconds").alias("duration_seconds"), F.col("_done.statistics").alias("final_statistics"),
        F.col("_failed.message").alias("error_message"), F.col("_failed.details").alias("error_details"),
        F.col("_undo.id").alias("rollback_id"), F.col("_undo.reason").alias("rollback_reason"), F.col("_undo.at").alias("rollback_initiated_at"),
        F.col("_undone.success").alias("rollback_success"), F.col("_undone.at").alias("rollback_completed_at"),
        F.coalesce("_ended.status", F.lit("started")).alias("status"),
    )


def fold_runs(pointing: DataFrame, starts: DataFrame, order: Sequence[str] = EVENT_ORDER, runs: DataFrame | None = None) -> DataFrame:
    """The read model of the runs in ``starts``, from the events that point somewhere (see :func:`pointing_events`).

    Only what belongs to a run is parsed. With ``runs`` only these are folded; the other starts are there for the keys that they share with them.
    """
    links = link_table(starts)
    if runs is not None:
        links, starts = links.join(runs, "run_id", "left_semi"), starts.join(runs, "run_id", "left_semi")
    linked = _linked(pointing.select(*dict.fromkeys([*POINTING, *order])), links, order)
    return model_rows(starts, parsed(linked).groupBy("run_id").agg(*accumulated(order)))


def run_read_model(events: DataFrame, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """One row per run: status, times, counters, last rollback.

    The latest starts, one row per run, are written once; the other events are read in one pass.
    """
    return fold_runs(pointing_events(events), materialise(latest_starts(events, order), "starts"), order)


def run_errors(events: DataFrame, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """Validation errors of every run as rows, none left out."""
    linked = linked_events(events.filter(F.col("event_type") == "data.validated"), latest_starts(events, order), order)
    linked = linked.filter(payload_long(F.col("event_data"), "invalid_records") > 0)
    errors = F.from_json(payload_text(F.col("event_data"), "validation_errors"), "array<string>")
    return linked.select("run_id", "event_id", "timestamp", F.posexplode(errors).alias("position", "error"))


def moved_entities(events: DataFrame, event_type: str = USER_MOVED, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """The last run event of every user (or admin)."""
    data = F.col("event_data")
    last = F.struct(
        F.coalesce(payload_text(data, "username"), F.lit("")).alias("username"),
        F.col("timestamp").alias("moved_at"),
        F.coalesce(payload_text(data, "source_data"), F.lit("{}")).alias("source_data"),
        F.coalesce(payload_text(data, "target_data"), F.lit("{}")).alias("target_data"),
    )
    chosen = events.filter(F.col("event_type") == event_type)
    return chosen.groupBy("aggregate_id").agg(F.max_by(last, _place(order)).alias("_r")).select("aggregate_id", "_r.*")


def snapshots(events: DataFrame, up_to_version: int | None = None, order: Sequence[str] = EVENT_ORDER, as_of: Column | None = None) -> DataFrame:
    """State of every run up to a version, as snapshot rows made at ``as_of`` (default: now)."""
    seen = events if up_to_version is None else events.filter(F.col("event_version") <= up_to_version)
    model = run_read_model(seen, order)
    own = seen.groupBy(F.col("aggregate_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("replayed"), F.max("event_version").alias("version")
    )
    state = F.to_json(F.struct(*[c for c in model.columns if c != "run_id"]))
    return model.join(own, "run_id", "left").select(
        F.col("run_id").alias("aggregate_id"),
        F.lit(RUN).alias("aggregate_type"),
        "version",
        "replayed",
        state.alias("snapshot_data"),
        (F.current_timestamp() if as_of is None else as_of).alias("created_at"),
    )


def upsert(current: DataFrame, changes: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Insert or replace by key; ``created_at`` stays what it was, ``updated_at`` becomes ``as_of``."""
    born = current.select(key, F.col("created_at").alias("_born"))
    written = (
        changes.join(born, key, "left")
        .withColumn("created_at", F.coalesce("_born", as_of))
        .withColumn("updated_at", as_of)
        .drop("_born")
    )
    return current.join(changes.select(key), key, "left_anti").unionByName(written)


def new_events(events: DataFrame, last_timestamp=None, last_event_id: str | None = None) -> DataFrame:
    """Events after a projection's bookmark (time, id)."""
    if last_timestamp is None:
        return events
    at = F.lit(last_timestamp).cast("timestamp")
    return events.filter((F.col("timestamp") > at) | ((F.col("timestamp") == at) & (F.col("event_id") > F.lit(last_event_id))))


def bookmark(events: DataFrame, projection: str) -> DataFrame:
    """The projection row that says up to where events were folded."""
    last = F.max(F.struct("timestamp", "event_id"))
    return events.agg(last.alias("_l")).select(
        F.lit(projection).alias("projection_name"),
        F.col("_l.event_id").alias("last_processed_event_id"),
        F.col("_l.timestamp").alias("last_processed_timestamp"),
    )


def advance_counts(state: DataFrame, events: DataFrame, keys: Sequence[str], count: str = "events") -> DataFrame:
    """Fold new events into stored counts per key."""
    fresh = events.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return state.select(*keys, count).unionByName(fresh).groupBy(*keys).agg(F.sum(count).alias(count))


@dataclass(frozen=True)
class Handler:
    """What to do with events in a replay: which types, how to fold them, which rows fail."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    types: tuple[str, ...] | None = None
    error: Column | None = None

    def takes(self) -> Column:
        return F.lit(True) if self.types is None else F.col("event_type").isin(*self.types)


@dataclass(frozen=True)
class Replay:
    result: DataFrame
    errors: DataFrame
    outputs: dict[str, DataFrame]


def replay(selection: DataFrame, handlers: Sequence[Handler], event_filter: Column | None = None) -> Replay:
    """Run handlers over selected events again.

    ``total_events`` counts the selection before the filter, so ``success_rate`` does too.
    """
    passes = F.coalesce(event_filter, F.lit(False)) if event_filter is not None else F.lit(True)
    problems = [F.when(h.takes(), h.error) for h in handlers if h.error is not None]
    error = F.coalesce(*problems) if problems else F.lit(None).cast("string")
    judged = selection.withColumns({"_passes": passes, "_error": F.when(passes, error)})
    kept = judged.filter("_passes")
    result = judged.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("_passes") & F.col("_error").isNull()).alias("processed_events"),
        F.count("_error").alias("failed_events"),
    ).withColumn(
        "success_rate",
        F.when(F.col("total_events") > 0, F.col("processed_events") / F.col("total_events") * 100).otherwise(F.lit(0.0)),
    )
    errors = kept.filter(F.col("_error").isNotNull()).select(
        "event_id", "event_type", "aggregate_id", "timestamp", F.col("_error").alias("error")
    )
    good = kept.filter(F.col("_error").isNull()).drop("_passes", "_error")
    return Replay(result, errors, {h.name: h.apply(good.filter(h.takes())) for h in handlers})


def route_events(events: DataFrame, subscriptions: DataFrame, running: Column | None = None) -> DataFrame:
    """(subscriber, event) for every subscriber of the event's type; nothing while the bus is stopped.

    There are few event types and so few, hot keys: the list is broadcast when it is short and
    spread otherwise.
    """
    wanted = subscriptions.select("subscriber", "event_type").distinct()
    open_events = events if running is None else events.filter(running)
    return lookup_join(open_events.filter(known_type(F.col("event_type"))), wanted, ["event_type"], ["event_id"])
