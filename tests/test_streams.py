"""Positions, deliveries and merges of streams: repeated and cut-short batches change nothing."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from ferrylog.functions import payloads
from ferrylog.operators.sequences import sliding_window
from ferrylog.plans import read_models
from ferrylog.plans.event_model import EVENT_SCHEMA, RUN_STARTED
from ferrylog.streaming import consumers, deliveries, live, merging, numbering
from test_run_state import history


def table(spark, ids):
    return spark.createDataFrame([(i, i % 5) for i in ids], "id long, v int").repartition(3)


@pytest.mark.parametrize("target", [1_000_000, 4])
def test_numbers_go_on_and_repeat(spark, tmp_path, target):
    kept, wins, state = (str(tmp_path / n) for n in ("kept", "wins", "state"))
    parts = [range(0, 13), range(13, 15), range(15, 15), range(15, 40)]
    rows = numbering.numbered(numbering.keep_rows(kept), f"{state}-a", ["v", "id"], target_rows=target)
    windows = numbering.numbered(numbering.keep_windows(wins, 6, 2), f"{state}-b", ["id"], keep=5, target_rows=target)
    for number, ids in enumerate(parts):
        for _ in range(1 + number % 2):
            rows(table(spark, ids), number)
            windows(table(spark, ids), number)
    shutil.rmtree(f"{state}-a/ends/batch=3")  # died before its end was written: tried again
    rows(table(spark, parts[3]), 3)
    want = [i for ids in parts for i in sorted(ids, key=lambda i: (i % 5, i))]
    found = numbering.kept_rows(spark, kept, spark.createDataFrame([], "id long, v int, seq long").schema).orderBy("seq").collect()
    assert [(r.seq, r.id) for r in found] == list(enumerate(want, 1))
    have = spark.read.parquet(f"{wins}/batch=*").select("window_id", "id", "pos").collect()
    whole = sliding_window(table(spark, range(40)), 6, ["id"], 2).select("window_id", "id", "pos").collect()
    assert sorted(have) == sorted(whole)


def events(spark, rows):
    return spark.createDataFrame([(e, t, "a", "x", 1, None, None, None, "{}", "{}") for e, t in rows], EVENT_SCHEMA)


def test_a_repeated_batch_delivers_once(spark, tmp_path):
    out, subs = str(tmp_path / "out"), str(tmp_path / "subs")
    handle = deliveries.deliver(out, subs, {"counts": lambda df: df.groupBy("event_type").count()})
    handle(events(spark, [("e0", "data.imported")]), 0)  # nobody has subscribed
    at = lambda day: F.lit(f"2024-01-0{day}")
    deliveries.change_subscription(spark, subs, "one", ["data.imported", "data.extracted"], True, at(1))
    deliveries.change_subscription(spark, subs, "counts", ["data.imported"], True, at(1))
    first, second = [("e1", "data.imported"), ("e2", "data.extracted"), ("e3", "no.such")], [("e4", "data.imported"), ("e5", "data.extracted")]
    handle(events(spark, first), 1)
    deliveries.change_subscription(spark, subs, "one", ["data.imported"], False, at(2))
    deliveries.change_subscription(spark, subs, "two", ["data.imported"], True, at(2))
    handle(events(spark, first), 1)  # tried again: by the subscriptions of its first try
    handle(events(spark, second), 2)
    handle(events(spark, second), 2)
    have = sorted((r.subscriber, r.event_id) for r in deliveries.delivered(spark, out).collect())
    assert have == [("one", "e1"), ("one", "e2"), ("one", "e5"), ("two", "e4")]
    assert sum(r["count"] for r in deliveries.viewed(spark, out, "counts").collect()) == 2
    assert sorted(deliveries.subscriptions(spark, subs).collect()) == [("counts", "data.imported"), ("one", "data.extracted"), ("two", "data.imported")]


def test_a_streamed_model_equals_the_whole_fold(spark, tmp_path):
    """Batches in no order of time, runs that share keys; a start's event is kept under its run only, other keys lead there."""
    rows, model = history(6, 240), str(tmp_path / "model")
    handle = consumers.maintain_read_model(str(tmp_path / "store"), model, buckets=2)
    for number, part in enumerate((rows[1::2], rows[0::4], rows[2::4] + rows[:20])):
        handle(spark.createDataFrame(part, EVENT_SCHEMA), number)
    whole = read_models.run_read_model(spark.createDataFrame(rows, EVENT_SCHEMA))
    have = consumers.current_read_model(spark, model).select(whole.columns)
    assert have.exceptAll(whole).isEmpty() and whole.exceptAll(have).isEmpty()
    starts = spark.read.parquet(f"{model}/starts")
    own = starts.filter("link_key = run_id")
    assert own.filter("event_data IS NULL").isEmpty() and own.count() == sum(r[1] == RUN_STARTED for r in rows)
    assert starts.filter("link_key <> run_id AND event_data IS NOT NULL").isEmpty() and starts.count() > own.count()


def test_text_is_one_json_value(spark):
    texts = ["{}", "[]", "1", ' {"a": [1, {"b": 2}]} ', '"x"', "null", "", " ", None, "1]", "1}", "1,2", '1, "v": 2', '1}, {"v": 2', "1], [2", '{"a": 1} x', '{"a": 1}]', '{"a": 1}}', '{"a": 1, "a": 2}', '{"a"', "nul", "{} {}", "[1,]", "1} ]", "1] }"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(payloads.is_json(F.col("t")).alias("is"), payloads.json_value(F.col("t")).isNotNull().alias("was"))
    found = df.collect()
    assert [r["is"] for r in found] == [r.was for r in found] == [True] * 6 + [False] * 19


def test_policy_is_put_back(spark):
    before = spark.conf.get(merging.POLICY)
    with merging.watermark_policy(spark, "max"):
        assert spark.conf.get(merging.POLICY) == "max"
    assert spark.conf.get(merging.POLICY) == before
    with pytest.raises(ValueError), merging.watermark_policy(spark, "mean"):
        pass


def test_live_metrics(spark, tmp_path):
    assert live.live_counts(spark, str(tmp_path / "none")).collect() == []
    rows = [("r", "n", "t", 10, 9, 1, 0, 2.0, "q", 0), ("r", "n", "t", 10, 8, 2, 4, 3.0, "q", 1)]
    counts = spark.createDataFrame(rows, live.live_counts(spark, str(tmp_path / "none")).schema)
    r = live.live_metrics(counts).first()
    assert (r.batches, r.rows, r.completed, r.failed, r.late, r.healthy, r.rows_per_second) == (2, 20, 17, 3, 4, False, 4.0)
