"""A run's model resumed from stored states against the fold of all history."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ferrylog.plans import read_models, run_state
from ferrylog.plans.event_model import ADMIN_MOVED, EVENT_SCHEMA, RUN, RUN_COMPLETED, RUN_FAILED, RUN_ID, RUN_STARTED, USER_MOVED
from ferrylog.sources import event_store

BEGIN = datetime(2024, 3, 1, tzinfo=timezone.utc)


def history(seed: int, count: int = 500):
    """Few runs and fewer keys, so that starts reset runs, take keys from others and release them; many events share a moment."""
    rng = random.Random(seed)
    runs = [f"m{i}" for i in range(8)]
    shared = ["c1", "c2", "c3", "m1", "m2", None]
    rows, starts = [], ["none"]
    for i in range(count):
        event_id, at, run = f"e{i:05d}", BEGIN + timedelta(hours=i // 3), rng.choice(runs)
        kind = rng.choice([RUN_STARTED] * 2 + [RUN_COMPLETED, RUN_FAILED, "rollback.initiated", "rollback.completed"] + ["data.extracted", "data.transformed", "data.validated", "data.imported", USER_MOVED, ADMIN_MOVED] * 2 + ["other"])
        key = rng.choice([rng.choice(shared), rng.choice(starts[-6:]), run])
        data = {
            RUN_STARTED: f'{{"source_config": "{event_id}"}}', RUN_COMPLETED: f'{{"duration_seconds": {i}}}', RUN_FAILED: f'{{"error_message": "x{i}"}}',
            "rollback.initiated": f'{{"{RUN_ID}": "{run}", "reason": "r{i}"}}', "rollback.completed": f'{{"{RUN_ID}": "{run}", "success": true}}',
            "data.extracted": f'{{"record_count": {i}}}', "data.transformed": f'{{"output_count": {i}}}', "data.imported": '{"imported_count": "none"}',
            "data.validated": '{"valid_records": 2, "invalid_records": 1, "validation_errors": ["a", "b"]}',
        }.get(kind, "{}")
        own = kind in (RUN_STARTED, RUN_COMPLETED, RUN_FAILED)
        if kind == RUN_STARTED:
            starts.append(event_id)
        rows.append((event_id, kind, run if own else f"a{i}", RUN if own else "x", i % 5, at, key, None, None, data))
    return rows


def rows_of(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).fillna("null").collect()) if df is not None else []


@pytest.mark.parametrize(("seed", "target"), [(1, 1_000_000), (2, 40)])
def test_advance_equals_the_whole_fold(spark, seed, target):
    rows = history(seed)
    state = run_state.empty_state(spark)
    done = 0
    for cut in (200, 201, 500):
        state = run_state.advance(state, spark.createDataFrame(rows[done:cut], EVENT_SCHEMA), target)
        done = cut
        whole = read_models.run_read_model(spark.createDataFrame(rows[:cut], EVENT_SCHEMA))
        have = run_state.model_of(state).select(whole.columns)
        assert have.exceptAll(whole).isEmpty() and whole.exceptAll(have).isEmpty() and have.count() == whole.count()
        assert state.mark.collect() == [(rows[cut - 1][5].replace(tzinfo=None), rows[cut - 1][0])]
    latest = {r.link_key: r.n for r in state.epochs.filter("way = 'own'").groupBy("link_key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(latest.values()) == {1}  # epochs that cannot count any more are gone


def test_resume_reads_days_behind_the_mark_only(spark, tmp_path):
    rows = history(3, 300)
    store, states = str(tmp_path / "store"), str(tmp_path / "states")
    event_store.append_events(spark.createDataFrame(rows[:200], EVENT_SCHEMA), store, batch="one")
    run_state.resume(spark, store, states)
    event_store.append_events(spark.createDataFrame(rows[200:], EVENT_SCHEMA), store, batch="two")
    mark = run_state.load(spark, states, 0).mark.first()
    plan = event_store.events_after(spark, store, *mark)._jdf.queryExecution().toString()
    assert f"(event_date#" in plan and f">= {mark.timestamp:%Y-%m-%d})" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    state = run_state.resume(spark, store, states)
    whole = read_models.run_read_model(spark.createDataFrame(rows, EVENT_SCHEMA))
    have = run_state.model_of(state).select(whole.columns)
    assert have.exceptAll(whole).isEmpty() and whole.exceptAll(have).isEmpty()
    again = run_state.resume(spark, store, states)  # nothing new
    assert run_state.model_of(again).select(whole.columns).exceptAll(whole).isEmpty()
    assert run_state.saved(spark, states) == [1, 2]  # the newest two stay
    snaps = run_state.snapshots_of(again, F.lit(BEGIN).cast("timestamp")).collect()
    assert len(snaps) == 8 and all(r.replayed and r.aggregate_type == RUN for r in snaps)


def test_unfinished_state_counts_for_nothing(spark, tmp_path):
    rows, states = history(4, 120), str(tmp_path / "states")
    store = str(tmp_path / "store")
    event_store.append_events(spark.createDataFrame(rows[:60], EVENT_SCHEMA), store, batch="one")
    state = run_state.resume(spark, store, states)
    for name in ("starts", "epochs"):  # a save that died before its mark
        getattr(state, name).limit(1).write.parquet(f"{states}/{name}/state=1")
    event_store.append_events(spark.createDataFrame(rows[60:], EVENT_SCHEMA), store, batch="two")
    state = run_state.resume(spark, store, states)
    whole = read_models.run_read_model(spark.createDataFrame(rows, EVENT_SCHEMA))
    assert run_state.model_of(state).select(whole.columns).exceptAll(whole).isEmpty()
    assert run_state.saved(spark, states) == [0, 1]


def test_only_events_that_can_count_are_placed(spark, monkeypatch):
    """Events before the latest starts under their key are left out before they are put into epochs, and superseded starts open none."""
    rows, seen, true_running = history(5), [], run_state.running

    def running(df, *args):
        seen.append({r["_kind"]: r["n"] for r in df.groupBy("_kind").agg(F.count(F.lit(1)).alias("n")).collect()})
        return true_running(df, *args)

    monkeypatch.setattr(run_state, "running", running)
    state = run_state.advance(run_state.empty_state(spark), spark.createDataFrame(rows, EVENT_SCHEMA))
    latest, ways = {}, {}
    for r in rows:
        if r[1] == RUN_STARTED:
            latest[r[2]] = r
    for run, r in latest.items():
        for key in {("own", run), ("link", run), ("link", r[0]), ("link", r[6])}:
            ways.setdefault(key, set()).add((r[5], r[0]))
    ways = {k: v for k, v in ways.items() if k[1] is not None}
    key_of = lambda r: ("own", r[2]) if r[1] in (RUN_COMPLETED, RUN_FAILED) else ("own", r[9].split('"')[3]) if r[1].startswith("rollback.") else ("link", r[6])
    pointing = [r for r in rows if r[1] not in (RUN_STARTED, "other")]
    can = [r for r in pointing if key_of(r) in ways and (r[5], r[0]) >= min(ways[key_of(r)])]
    assert seen == [{0: sum(map(len, ways.values())), 1: len(can)}] and len(can) < len(pointing) / 2
    whole = read_models.run_read_model(spark.createDataFrame(rows, EVENT_SCHEMA))
    have = run_state.model_of(state).select(whole.columns)
    assert have.exceptAll(whole).isEmpty() and whole.exceptAll(have).isEmpty()


def test_empty(spark):
    state = run_state.advance(run_state.empty_state(spark), spark.createDataFrame([], EVENT_SCHEMA))
    assert run_state.model_of(state).collect() == [] and state.mark.collect() == []
