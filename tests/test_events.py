"""The six-event history, replay, routing, dead letters, plans."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ferrylog.plans import event_model, event_queries, read_models
from ferrylog.plans.event_model import COMPLETED_TEXT, EVENT_SPECS, RUN_COMPLETED, RUN_ID, RUN_STARTED, TOPIC_PREFIX, USER_MOVED, make_events
from ferrylog.sources import event_store, messages
from workloads.adapters import envelopes, raw_events, source_users

START = datetime(2024, 1, 1)


def event(spark, at, event_type, aggregate_id, correlation="corr", event_id=None, **payload):
    fields = {f: F.lit(payload.get(f)) if not isinstance(payload.get(f), list) else F.array(*map(F.lit, payload[f])) for f in EVENT_SPECS[event_type].fields}
    one = spark.range(1)
    return make_events(
        one, event_type, F.lit(aggregate_id), F.lit(START + timedelta(seconds=at)).cast("timestamp"), fields,
        event_id=F.lit(event_id or f"e{at}"), correlation_id=F.lit(correlation),
    )


def together(*frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@pytest.fixture(scope="module")
def six(spark):
    return together(
        event(spark, 0, RUN_STARTED, "m1"),
        event(spark, 1, "data.extracted", "x1", source_type="panel", record_count=50),
        event(spark, 2, "data.transformed", "t1", input_count=50, output_count=50),
        event(spark, 3, USER_MOVED, "user-1", username="testuser1"),
        event(spark, 4, USER_MOVED, "user-2", username="testuser2"),
        event(spark, 5, RUN_COMPLETED, "m1", duration_seconds=60.0),
    ).cache()


def test_read_model(six):
    row = read_models.run_read_model(six).first()
    assert (row.run_id, row.status, row.extracted_count, row.transformed_count, row.user_count) == ("m1", "completed", 50, 50, 2)
    assert row.duration_seconds == 60.0


def test_links_by_start_event_id_and_own_id(spark):
    for correlation in ("start-id", "m1"):
        both = together(event(spark, 0, RUN_STARTED, "m1", None, "start-id"), event(spark, 1, "data.extracted", "x", correlation, record_count=100))
        assert read_models.run_read_model(both).first().extracted_count == 100


def test_restart_forgets(spark, six):
    again = six.unionByName(event(spark, 10, RUN_STARTED, "m1"))
    row = read_models.run_read_model(again).first()
    assert (row.status, row.user_count, row.extracted_count) == ("started", 0, 0)


def test_rollback_and_errors(spark, six):
    more = together(
        six,
        event(spark, 6, "data.validated", "v", total_records=3, valid_records=1, invalid_records=2, validation_errors=["a", "b"]),
        event(spark, 7, "rollback.initiated", "r1", None, **{RUN_ID: "m1"}, reason="bad"),
        event(spark, 8, "rollback.completed", "r1", None, **{RUN_ID: "m1"}, success=False),
        event(spark, 9, "rollback.initiated", "r2", None, **{RUN_ID: "other"}, reason="unknown"),
    )
    row = read_models.run_read_model(more).first()
    assert (row.error_count, row.rollback_reason, row.rollback_success, row.validated_count) == (2, "bad", False, 1)
    assert [r.error for r in read_models.run_errors(more).orderBy("position").collect()] == ["a", "b"]
    told = {r.event_type: (r.priority, r.message) for r in event_model.notifications(more).filter("aggregate_id <> 'r2'").collect()}
    assert told[RUN_COMPLETED] == ("normal", COMPLETED_TEXT % ("m1", 60))
    assert told["rollback.completed"][0] == "high"


def test_replay(six):
    handler = read_models.Handler("runs", read_models.run_read_model)
    result = read_models.replay(six, [handler]).result.first()
    assert (result.total_events, result.processed_events, result.failed_events, result.success_rate) == (6, 6, 0, 100.0)
    users = read_models.replay(event_queries.by_types(six, [USER_MOVED]), [handler]).result.first()
    assert users.processed_events == 2
    assert read_models.moved_entities(six).count() == 2
    correlated = read_models.replay(event_queries.by_correlation(six, "corr"), [handler])
    assert correlated.result.first().processed_events == 6
    assert correlated.outputs["runs"].first().user_count == 2
    filtered = read_models.replay(six, [handler], F.col("event_type") == USER_MOVED).result.first()
    assert (filtered.total_events, filtered.processed_events, round(filtered.success_rate, 2)) == (6, 2, 33.33)


def test_snapshot_and_sequence(six):
    snap = read_models.snapshots(six).first()
    assert (snap.aggregate_id, snap.replayed) == ("m1", 2) and '"status":"completed"' in snap.snapshot_data and '"user_count":2' in snap.snapshot_data
    own = six.filter("aggregate_id = 'm1'")
    good = event_queries.sequence_verdicts(own, [RUN_STARTED, RUN_COMPLETED]).first()
    assert good.is_valid
    bad = event_queries.sequence_differences(own, [RUN_COMPLETED, RUN_STARTED, "data.extracted"])
    assert sorted((r.position, r.expected, r.actual) for r in bad.collect()) == [
        (0, RUN_COMPLETED, RUN_STARTED), (1, RUN_STARTED, RUN_COMPLETED), (2, "data.extracted", None)
    ]


def test_wrong_payload_is_refused(spark):
    with pytest.raises(ValueError):
        make_events(spark.range(1), "data.extracted", F.lit("x"), F.lit(START).cast("timestamp"), {"record_count": F.lit(1)})


def test_messages_round_trip_and_dead_letters(spark, six):
    sent = messages.encode_messages(six, TOPIC_PREFIX)
    assert {r.topic for r in sent.collect()} == {f"{TOPIC_PREFIX}." + t.replace(".", "_") for t in (RUN_STARTED, "data.extracted", "data.transformed", USER_MOVED, RUN_COMPLETED)}
    odd = spark.createDataFrame([("t", "k", "no json"), ("t", "k", json.dumps({"event_type": USER_MOVED})), ("t", "k", '{"event_id": "1", "event_type": "odd"}')], "topic string, key string, value string")
    good, dead = messages.split_dead_letters(messages.decode_messages(sent.unionByName(odd)), F.lit(START).cast("timestamp"))
    assert good.count() == 6
    found = sorted(r.e for r in dead.select(F.get_json_object("event_metadata", "$.error").alias("e")).collect())
    assert found == ["no event id", "not JSON", "unknown event type"]


def test_audit_summarises_by_kind(spark):
    body = '{"a": {"x": 1}, "b": [1, 2], "c": "' + "x" * 101 + '", "d": "[1]", "e": 5, "f": null}'
    row = spark.createDataFrame([("1", "uuid.transformed", "a", "t", START, None, None, "{}", body)], "event_id string, event_type string, aggregate_id string, aggregate_type string, timestamp timestamp, correlation_id string, causation_id string, event_metadata string, event_data string")
    summary = event_model.audit_entries(row).first().data_summary
    assert summary == {"a": "<dict with 1 keys>", "b": "<list with 2 items>", "c": "<string: " + "x" * 100 + "...>", "d": "[1]", "e": "5", "f": None}


def test_append_is_repeatable(spark, six, tmp_path):
    path = str(tmp_path / "events")
    for _ in range(2):
        event_store.append_events(six.unionByName(six), path, new_only=True)
    assert event_store.read_events(spark, path).count() == 6


def test_an_id_is_stored_once_whatever_its_time(spark, six, tmp_path):
    path = str(tmp_path / "events")
    event_store.append_events(six, path, new_only=True)
    later = six.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY"))
    event_store.append_events(later.unionByName(event(spark, 99, "data.imported", "x")), path, new_only=True, batch="b")
    event_store.append_events(later.unionByName(event(spark, 99, "data.imported", "x")), path, new_only=True, batch="b")
    have = event_store.read_events(spark, path)
    assert have.count() == 7 and have.join(six.select("event_id", "timestamp"), ["event_id", "timestamp"], "left_semi").count() == 6
    plan = plan_of(event_store.stored_ids(spark, path, [3, 5]))
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("\n", "") or "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]


def test_streamed_model_reads_touched_buckets(spark, six, tmp_path):
    from ferrylog.streaming import consumers

    store, model = str(tmp_path / "store"), str(tmp_path / "model")
    handle = consumers.maintain_read_model(store, model, buckets=4)
    halves = [six.filter("event_type NOT LIKE '%started'"), six.filter("event_type LIKE '%started'"), six]
    for n, part in enumerate(halves):  # ends before starts, then all of it again
        handle(part, n)
    row = consumers.current_read_model(spark, model).first()
    assert (row.run_id, row.status, row.extracted_count, row.user_count) == ("m1", "completed", 50, 2)
    assert event_store.read_events(spark, store).count() == 6
    consumers.compact_read_model(spark, model)
    assert consumers.current_read_model(spark, model).count() == spark.read.parquet(f"{model}/model_compact").count() == 1
    kept = consumers._kept(spark, model, "pointing", consumers._schemas(spark)["pointing"], [1])
    assert "bucket#" in plan_of(kept).split("PartitionFilters")[1].split("]")[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_core_stays_in_the_engine(spark, folder):
    """No Python in the core operators, and filters and columns reach the scan."""
    from ferrylog.operators import sequences
    from ferrylog.plans import accounts

    e, raw = envelopes(spark, folder), raw_events(spark, folder)
    for df in (
        read_models.run_read_model(e),
        event_queries.event_summary(e),
        sequences.throttle(raw, "ts", 60, ["ts", "event_id"], ["user_id"]),
        sequences.moving_average_exponential(raw, "value", ["ts", "event_id"], ["user_id"]),
        accounts.transform_users(source_users(spark, folder), START),
    ):
        plan = plan_of(df)
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    selected = plan_of(spark.read.parquet(f"{folder}/events.parquet").filter(F.col("event_type") == "view").select("event_id"))
    assert "EqualTo(event_type,view)" in selected


def test_newest_rows_are_kept_before_the_shuffle(spark, folder):
    from ferrylog.operators import sequences

    plan = plan_of(sequences.keep_newest(raw_events(spark, folder), 3, ["ts", "event_id"], ["user_id"]))
    assert "WindowGroupLimit" in plan


def test_stored_events_are_pruned(spark, six, tmp_path):
    path = str(tmp_path / "events")
    event_store.append_events(six, path)
    plan = plan_of(event_queries.by_aggregate(event_store.read_events(spark, path), "m1").select("event_id"))
    assert "EqualTo(aggregate_id,m1)" in plan and "event_data" not in plan.split("ReadSchema")[1]


def test_events_under_other_names(spark):
    rows = [("e1", "job.begun", "a", "job", '{"job": "x", "n": {"deep": [1]}}'), ("e2", "other", "a", "z", '{"n": 1}'), ("e3", "job.begun", "a", None, "no JSON"), ("e4", None, "a", "job", '{"job": 1, "run_id": 2}')]
    df = spark.createDataFrame(rows, "event_id string, event_type string, aggregate_id string, aggregate_type string, event_data string")
    named = event_model.with_our_names(df, {"job.begun": event_model.RUN_STARTED}, {"job": event_model.RUN}, {"job": event_model.RUN_ID})
    have = {r.event_id: (r.event_type, r.aggregate_type, r.event_data) for r in named.collect()}
    assert have == {
        "e1": (event_model.RUN_STARTED, event_model.RUN, '{"run_id":"x","n":{"deep":[1]}}'), "e2": ("other", "z", '{"n": 1}'),
        "e3": (event_model.RUN_STARTED, None, "no JSON"), "e4": (None, event_model.RUN, '{"job":1,"run_id":2}'),
    }
    assert event_model.with_our_names(df, {}).collect() == df.collect()
