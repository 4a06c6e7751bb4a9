"""The run read model as a state that is stored, resumed and merged, so that history is folded once.

An event counts for the run its key leads to, if it comes after the run's latest start; a later start may reset a run, take a key from
another run or leave one to it. So what is added up is not kept per run but per key and *epoch*, the stretch from one start under
that key to the next: sums and the last events of each kind, which merge. A run's row is the merge of its keys' epochs
from its latest start on, whoever had the key meanwhile; a start opens a new epoch and changes none before. Only starts that are their run's latest
when a state is made open one, since no other can become it later. Epochs before the
earliest latest start under their key can never count again and are left out; so are the events in them, before they are parsed and placed.

All that a stored state knows lies up to its mark, a place in ``EVENT_ORDER``. Advancing it reads the days from the mark on only. Events that
arrive later with a time before the mark are not seen; store a state behind the time up to which events are complete.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.functions.schemas import BOOL, DOUBLE, LONG, MOMENT, TEXT, struct
from ferrylog.operators.ordering import TARGET_ROWS, running
from ferrylog.plans.event_model import EVENT_ORDER, EVENT_SCHEMA, RUN
from ferrylog.plans.read_models import COUNTED, KEPT, STARTED, accumulated, link_table, merged, model_rows, parsed, pointing_events, run_keys
from ferrylog.session import materialise
from ferrylog.sources.event_store import delete_folder, events_after, finished

PLACE = struct(timestamp=MOMENT, event_id=TEXT)
STARTS = struct(run_id=TEXT, event_id=TEXT, correlation_id=TEXT, started_at=MOMENT, source_config=TEXT, target_config=TEXT, _from=PLACE)
_LAST = dict(
    _ended=struct(place=PLACE, status=TEXT),
    _done=struct(place=PLACE, at=MOMENT, seconds=DOUBLE, statistics=TEXT),
    _failed=struct(place=PLACE, at=MOMENT, message=TEXT, details=TEXT),
    _undo=struct(place=PLACE, at=MOMENT, id=TEXT, reason=TEXT),
    _undone=struct(place=PLACE, at=MOMENT, success=BOOL),
)
EPOCHS = struct(way=TEXT, link_key=TEXT, since=PLACE, **{c: LONG for c in COUNTED}, **_LAST)
COUNTS = struct(run_id=TEXT, replayed=LONG, version=T.IntegerType())
MARK = struct(timestamp=MOMENT, event_id=TEXT)
KEY = ["way", "link_key", "since"]


@dataclass(frozen=True)
class RunState:
    """Latest starts, epochs, events per run's own aggregate, and the mark (at most one row)."""

    starts: DataFrame
    epochs: DataFrame
    counts: DataFrame
    mark: DataFrame

    TABLES = {"starts": STARTS, "epochs": EPOCHS, "counts": COUNTS, "mark": MARK}


def empty_state(spark: SparkSession) -> RunState:
    return RunState(**{name: spark.createDataFrame([], schema) for name, schema in RunState.TABLES.items()})


def _place() -> Column:
    return F.struct(*EVENT_ORDER)


def _latest(old: DataFrame, events: DataFrame) -> DataFrame:
    """The latest start of every run in the columns of ``STARTS``, and whether it is one of the events; only these are parsed."""
    rest = ["event_id", "correlation_id", "event_data", "_from"]
    given = events.filter((F.col("event_type") == STARTED) & F.col("aggregate_id").isNotNull()).withColumn("_from", _place())
    fresh = given.groupBy(F.col("aggregate_id").alias("run_id")).agg(F.max_by(F.struct(*rest), "_from").alias("_s")).select("run_id", "_s.*")
    started = parsed(fresh).select(
        "run_id", "event_id", "correlation_id", F.col("_from.timestamp").alias("started_at"),
        F.col("_p.source_config").alias("source_config"), F.col("_p.target_config").alias("target_config"), "_from", F.lit(True).alias("_new"),
    )
    both = old.withColumn("_new", F.lit(False)).unionByName(started)
    return both.groupBy("run_id").agg(F.max_by(F.struct(*STARTS.fieldNames()[1:], "_new"), "_from").alias("_s")).select("run_id", "_s.*")


def _ways(starts: DataFrame) -> DataFrame:
    """``way, link_key, run_id, _from``: each key under which events may point at a start, won or not."""
    own = starts.select(F.lit("own").alias("way"), F.col("run_id").alias("link_key"), "run_id", "_from")
    return run_keys(starts).select(F.lit("link").alias("way"), "link_key", "run_id", "_from").unionByName(own)


def _opened(starts: DataFrame) -> DataFrame:
    """The epochs that starts open, without any events yet."""
    empty = {f.name: F.lit(0 if f.name in COUNTED else None).cast(f.dataType) for f in EPOCHS if f.name not in KEY}
    return _ways(starts).select("way", "link_key", F.col("_from").alias("since")).distinct().withColumns(empty)


def _needed(starts: DataFrame) -> DataFrame:
    """``way, link_key, _least``: the place from which on events under a key can count."""
    return _ways(starts).groupBy("way", "link_key").agg(F.min("_from").alias("_least"))


def _counting(events: DataFrame, needed: DataFrame) -> DataFrame:
    """Events that can count, parsed: those under the keys of latest starts and not before these. Written, since they are gone through several times."""
    keyed = pointing_events(events).select("way", "link_key", *EVENT_ORDER, "event_type", "aggregate_id", "event_data")
    # the needed places are one row per key, so events need not be sorted to meet them
    found = keyed.join(needed.hint("shuffle_hash"), ["way", "link_key"]).filter(_place() >= F.col("_least"))
    return materialise(parsed(found).drop("event_data", "_least"), "counting")


def _in_epochs(counting: DataFrame, old: DataFrame, opened: DataFrame, target_rows: int) -> DataFrame:
    """Accumulated events per key and epoch; ``old`` has the epochs of the state, all before these events."""
    pointing = counting.withColumn("_kind", F.lit(1))
    last = old.groupBy("way", "link_key").agg(F.max("since").alias("since"))  # one epoch per key is open
    bounds = last.unionByName(opened.select(*KEY)).select("way", "link_key", "since", "since.*", F.lit(0).alias("_kind"))
    placed = running(pointing.unionByName(bounds, allowMissingColumns=True), {"_since": ("last", F.col("since"))}, [*EVENT_ORDER, "_kind"], ["way", "link_key"], target_rows)
    counted = placed.filter("_kind = 1 AND _since IS NOT NULL").drop("since").withColumnRenamed("_since", "since")
    return counted.groupBy(*KEY).agg(*accumulated())


def advance(state: RunState, events: DataFrame, target_rows: int = TARGET_ROWS) -> RunState:
    """The state after some more events, all of which come after its mark; each table is one merge of old and new."""
    events = events.select(*EVENT_SCHEMA.fieldNames())
    latest = materialise(_latest(state.starts, events), "starts")
    starts, opened = latest.drop("_new"), _opened(latest.filter("_new"))
    needed = materialise(_needed(starts), "needed")
    parts = [state.epochs, opened, _in_epochs(_counting(events, needed), state.epochs, opened, target_rows).select(*EPOCHS.fieldNames())]
    joined = reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(*merged())
    epochs = joined.join(needed, ["way", "link_key"]).filter("since >= _least").select(*EPOCHS.fieldNames())
    own = events.filter(F.col("aggregate_type") == RUN).groupBy(F.col("aggregate_id").alias("run_id")).agg(F.count(F.lit(1)).alias("replayed"), F.max("event_version").alias("version"))
    counts = state.counts.unionByName(own).groupBy("run_id").agg(F.sum("replayed").alias("replayed"), F.max("version").alias("version"))
    places = state.mark.unionByName(events.select(*EVENT_ORDER)).agg(F.max(_place()).alias("_m")).select("_m.*").filter("timestamp IS NOT NULL")
    return RunState(starts, materialise(epochs, "epochs"), materialise(counts, "counts"), materialise(places, "mark"))


def model_of(state: RunState) -> DataFrame:
    """The read model: one row per run, from the epochs that its keys have had since its latest start."""
    linked = state.epochs.join(link_table(state.starts), ["way", "link_key"]).filter("since >= _from")
    return model_rows(state.starts, linked.groupBy("run_id").agg(*merged()))


def snapshots_of(state: RunState, as_of: Column) -> DataFrame:
    """Snapshot rows as :func:`ferrylog.plans.read_models.snapshots` makes them; ``replayed`` counts the run's own aggregate."""
    model = model_of(state)
    data = F.to_json(F.struct(*[c for c in model.columns if c != "run_id"]))
    rows = model.join(state.counts, "run_id", "left")
    return rows.select(F.col("run_id").alias("aggregate_id"), F.lit(RUN).alias("aggregate_type"), "version", "replayed", data.alias("snapshot_data"), as_of.alias("created_at"))


def save(state: RunState, path: str, number: int) -> None:
    """Store a state under a number; its mark is written last and says that it is whole, so a save that was cut short counts for nothing."""
    for name in RunState.TABLES:
        getattr(state, name).write.mode("overwrite").parquet(f"{path}/{name}/state={number}")


def saved(spark: SparkSession, path: str) -> list[int]:
    """The numbers of whole states."""
    return sorted(int(folder.rsplit("state=", 1)[1]) for folder in finished(spark, f"{path}/mark", "state=*"))


def load(spark: SparkSession, path: str, number: int) -> RunState:
    return RunState(**{name: spark.read.schema(schema).parquet(f"{path}/{name}/state={number}") for name, schema in RunState.TABLES.items()})


def resume(spark: SparkSession, store_path: str, state_path: str, until: datetime | None = None, keep: int = 2) -> RunState:
    """Advance the newest stored state with what the event store has behind its mark (up to ``until``), store and return it.

    Without a stored state the whole store is folded. A repeated call finds nothing new behind the mark and stores an equal state.
    The ``keep`` newest states stay.
    """
    numbers = saved(spark, state_path)
    state = load(spark, state_path, numbers[-1]) if numbers else empty_state(spark)
    mark = state.mark.first()
    fresh = events_after(spark, store_path, *(mark if mark else (None, None)), until)
    number = numbers[-1] + 1 if numbers else 0
    save(advance(state, fresh), state_path, number)
    forget(spark, state_path, saved(spark, state_path)[:-keep])
    return load(spark, state_path, number)


def forget(spark: SparkSession, path: str, numbers: Sequence[int]) -> None:
    """Remove stored states, their marks first."""
    for number in numbers:
        for name in reversed(RunState.TABLES):
            delete_folder(spark, f"{path}/{name}/state={number}")
