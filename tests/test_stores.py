"""Stored tables: what is read and rewritten, and what a write that dies leaves behind."""

from __future__ import annotations

import glob
import hashlib
import os
import shutil
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.plans.event_model import EVENT_SCHEMA, RUN, RUN_STARTED
from ferrylog.sources import event_store, keyed_table, pages
from ferrylog.streaming import consumers

BEGIN = datetime(2024, 3, 1, tzinfo=timezone.utc)


def events(spark, ids, kind="data.imported"):
    rows = [(f"e{i}", kind, f"a{i}", RUN if kind == RUN_STARTED else "import", 1, BEGIN + timedelta(hours=i), hashlib.md5(str(i).encode()).hexdigest(), None, "{}", '{"imported_count": 1}') for i in ids]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def scanned(df) -> int:
    """Rows that the scan of a query gave."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "store")
    event_store.append_events(events(spark, range(24 * 20)), path)
    stored = event_store.read_events(spark, path)
    wanted = hashlib.md5(b"77").hexdigest()
    found = stored.filter(F.col("correlation_id") == wanted)
    assert [r.event_id for r in found.collect()] == ["e77"]
    assert scanned(stored.filter(F.length("correlation_id") > 0)) == 480
    assert scanned(found) <= 48  # one day of twenty, ids of all days being spread over one range
    assert scanned(stored.filter(F.col("aggregate_id") == "a78")) <= 48


def test_an_append_that_died_between_its_writes_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    event_store.append_events(events(spark, range(10)), path, new_only=True)
    shutil.rmtree(f"{path}_ids")  # the events were written, their ids were not
    event_store.append_events(events(spark, reversed(range(10))), path, new_only=True)
    event_store.append_events(events(spark, range(5, 15)), path, new_only=True)
    ids = [r.event_id for r in event_store.read_events(spark, path).collect()]
    assert sorted(ids) == sorted(f"e{i}" for i in range(15))


def test_an_unnamed_batch_is_made_once_and_kept_once(spark, tmp_path):
    path, made = str(tmp_path / "store"), spark.sparkContext.accumulator(0)

    def seen(text):
        made.add(1)
        return text

    watched = events(spark, range(50)).repartition(2).withColumn("event_data", F.udf(seen)("event_data"))
    event_store.append_events(watched, path)
    assert made.value == 50  # not once more for the batch's name
    want = sorted(map(tuple, events(spark, range(50)).collect()))
    read = lambda: sorted(map(tuple, event_store.read_events(spark, path).drop("event_date").collect()))
    assert read() == want
    (folder,) = glob.glob(f"{path}/batch=*")
    assert folder.endswith(f"batch={event_store.content_name(events(spark, range(50)))}") and not glob.glob(f"{path}_staged/*")
    event_store.append_events(events(spark, reversed(range(50))), path)  # the same events: nothing is added
    assert read() == want
    shutil.rmtree(f"{path}_ids")
    for name in glob.glob(f"{folder}/*SUCCESS*") + glob.glob(f"{folder}/.*SUCCESS*") + glob.glob(f"{folder}/event_date=2024-03-01"):  # died half-way
        (shutil.rmtree if "event_date" in name else os.remove)(name)
    assert read() == []
    event_store.append_events(events(spark, range(50)), path)
    assert read() == want and event_store.stored_ids(spark, path, list(range(event_store.ID_BUCKETS))).count() == 50


def test_batches_are_merged_and_read_once(spark, tmp_path):
    path, whole = str(tmp_path / "store"), str(tmp_path / "whole")
    for first in (0, 30, 60):
        event_store.append_events(events(spark, range(first, first + 40)), path, new_only=True, batch=f"b{first}")
    read = lambda p: sorted(r.event_id for r in event_store.read_events(spark, p).collect())
    want = sorted(f"e{i}" for i in range(100))
    assert read(path) == want
    for end in ("", "_ids"):
        shutil.copytree(f"{path}{end}", f"{whole}{end}")
    assert event_store.compact_events(spark, path) == 3
    assert read(path) == want and len(glob.glob(f"{path}/batch=*")) == len(glob.glob(f"{path}_ids/batch=*")) == 1
    # died before the parts were removed, and before the ids of the merge were written
    for end in ("", "_merged"):
        shutil.copytree(f"{path}{end}", f"{whole}{end}", dirs_exist_ok=True)
    assert read(whole) == want
    event_store.append_events(events(spark, range(90, 110)), whole, new_only=True, batch="late")
    assert read(whole) == sorted(f"e{i}" for i in range(110))
    assert event_store.compact_events(spark, whole) == 5  # the merge, its new batch, and the parts whose ids it has not
    assert read(whole) == sorted(f"e{i}" for i in range(110)) and len(glob.glob(f"{whole}/batch=*")) == len(glob.glob(f"{whole}_merged/*")) == 1
    # a batch that was merged is given again
    event_store.append_events(events(spark, range(30, 70)), path, new_only=True, batch="b30")
    assert read(path) == want
    assert event_store.compact_events(spark, str(tmp_path / "none")) == 0


def test_compaction_may_die_anywhere(spark, tmp_path):
    store, model = str(tmp_path / "store"), str(tmp_path / "model")
    handle = consumers.maintain_read_model(store, model, buckets=4)
    handle(events(spark, range(5), RUN_STARTED), 0)
    handle(events(spark, range(5, 8), RUN_STARTED), 1)
    want = sorted(map(tuple, consumers.current_read_model(spark, model).collect()))
    assert len(want) == 8
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    shutil.copytree(model, f"{model}-old")
    consumers.compact_read_model(spark, model)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    read = lambda path: sorted(map(tuple, consumers.current_read_model(spark, path).collect()))
    assert read(model) == want and not glob.glob(f"{model}/*/batch=0")
    # the compaction was written and nothing removed; and it was cut short before its end
    shutil.copytree(f"{model}/model_compact", f"{model}-old/model_compact")
    assert read(f"{model}-old") == want
    shutil.rmtree(f"{model}-old/model_compact")
    shutil.copytree(f"{model}/model_compact", f"{model}-old/model_compact", ignore=shutil.ignore_patterns("_SUCCESS", "bucket=1"))
    assert read(f"{model}-old") == want
    handle(events(spark, range(8, 11), RUN_STARTED), 2)
    consumers.compact_read_model(spark, model)
    handle(events(spark, range(11, 12), RUN_STARTED), 3)
    assert len(read(model)) == 12


KEYED = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())])


def files(path) -> dict[str, bytes]:
    return {f: hashlib.sha256(open(f, "rb").read()).digest() for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v string")
    keyed_table.upsert_keyed(rows(range(100), "one"), path, "id", F.lit("2024-01-01"), buckets=16)
    old = files(path)
    keyed_table.upsert_keyed(rows([5, 200], "two"), path, "id", F.lit("2024-01-02"), buckets=16)
    new = files(path)
    touched = {f.rsplit("/", 1)[0] for f in set(old) ^ set(new)}
    assert 1 <= len(touched) <= 2 and all(old[f] == new[f] for f in set(old) & set(new)) and len(set(old) & set(new)) >= 13
    read = lambda: sorted(tuple(r) for r in keyed_table.read_keyed(spark, path, KEYED).select("id", "v", F.day("created_at"), F.day("updated_at")).collect())
    want = sorted([(i, "one", 1, 1) for i in range(100) if i != 5] + [(5, "two", 1, 2), (200, "two", 2, 2)])
    assert read() == want
    keyed_table.upsert_keyed(rows([5, 200], "two"), path, "id", F.lit("2024-01-02"), buckets=16)  # a retry
    assert read() == want


def test_a_change_that_was_not_applied_is_applied_by_the_next_reader(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v string")
    keyed_table.upsert_keyed(rows(range(20), "one"), path, "id", F.lit("2024-01-01"), buckets=4)
    with monkeypatch.context() as m:
        m.setattr(keyed_table, "recover", lambda *a: 0)  # died after the change was written
        keyed_table.upsert_keyed(rows([3], "two"), path, "id", F.lit("2024-01-02"), buckets=4)
    for folder in glob.glob(f"{path}/bucket=*"):  # and in the middle of replacing buckets
        if spark.read.parquet(folder).filter("id = 3").count():
            shutil.rmtree(folder)
    found = {r.id: r.v for r in keyed_table.read_keyed(spark, path, KEYED).collect()}
    assert found == {i: "two" if i == 3 else "one" for i in range(20)}


def test_files_are_listed_by_their_numbers(spark):
    names = ["page_10.json", "page_2.json", "page_002b.json", "a1", "page_1.json", "page_0100.json", "p"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    have = [r.n for r in df.orderBy(pages.file_order(F.col("n")), "n").collect()]
    assert have == ["a1", "p", "page_1.json", "page_2.json", "page_002b.json", "page_10.json", "page_0100.json"]
