"""Structured Streaming consumers: events to the table, dead letters, read models, windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ferrylog.operators.sequences import buffer_tumbling
from ferrylog.plans.event_model import EVENT_SCHEMA
from ferrylog.plans.read_models import POINTING, fold_runs, latest_starts, pointing_events, start_keys
from ferrylog.session import materialise, shared_folder
from ferrylog.sources.event_store import STORED_SCHEMA, append_events, delete_folder, finished, processing_log
from ferrylog.sources.messages import dead_letter_messages, split_dead_letters


def _group_checkpoint(spark: SparkSession, consumer_group: str) -> str:
    return f"{shared_folder(spark)}/consumers/{consumer_group}"


def consume(
    events: DataFrame,
    consumer_group: str,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    dead_letter_path: str | None = None,
    check: Column | None = None,
    available_now: bool = True,
    log_path: str | None = None,
) -> StreamingQuery:
    """Hand good events of each micro-batch to ``handle``; the others go to the dead-letter sink.

    ``check`` gives the error text of an event that cannot be handled. ``log_path`` gets one row per event: processed or failed.
    A batch is decoded once and kept while it is handled, without the messages' text unless dead letters or log rows ask for it. Dead
    letters and log rows of a batch are written to a folder named after it, so a repeated batch replaces its own output.
    """
    events_only = not (dead_letter_path or log_path)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("error", F.coalesce("error", check)) if check is not None else batch
        kept = (split_dead_letters(judged, F.current_timestamp())[0] if events_only else judged).persist()
        try:
            good, dead = (kept, None) if events_only else split_dead_letters(kept, F.current_timestamp())
            handle(good.select(*EVENT_SCHEMA.fieldNames()), batch_id)
            if dead_letter_path:
                dead_letter_messages(dead).write.mode("overwrite").json(f"{dead_letter_path}/batch={batch_id}")
            if log_path:
                processing_log(kept, consumer_group).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        finally:
            kept.unpersist()

    writer = events.writeStream.foreachBatch(on_batch).queryName(consumer_group)
    writer = writer.option("checkpointLocation", checkpoint or _group_checkpoint(events.sparkSession, consumer_group))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def store_events(path: str, name: str = "stored") -> Callable[[DataFrame, int], None]:
    """A handler that appends events once, however often a batch is repeated.

    Consumers that share a store need different names: a batch's folder is named after both.
    """

    def handle(good: DataFrame, batch_id: int) -> None:
        append_events(good, path, new_only=True, batch=f"{name}-{batch_id}")

    return handle


#: The tables of the streamed read model lie in so many folders by a hash of what they are looked up by.
MODEL_BUCKETS = 64


def _touched(rows: DataFrame) -> list[int]:
    """The buckets of some rows; at most as many numbers as there are buckets."""
    return [r["bucket"] for r in rows.select("bucket").distinct().collect()]


def _keep(rows: DataFrame, path: str, table: str, batch_id: int) -> None:
    rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{table}/batch={batch_id}")


def _number(folder: str) -> int:
    return int(folder.rsplit("batch=", 1)[1])


def _kept(spark: SparkSession, path: str, table: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a state table (in some buckets), with the batch they came in; folders of other buckets are not read.

    They are those of the newest whole compaction, if there is one, and of the finished batches after it.
    """
    fields = [f for f in schema.fields if f.name not in ("bucket", "batch")]
    whole = T.StructType([*fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    parts, upto = [], -1
    compact = sorted(finished(spark, f"{path}/{table}_compact", "batch=*"), key=_number)
    if compact:
        upto = _number(compact[-1])
        parts.append((f"{path}/{table}_compact", compact[-1:]))
    later = [f for f in finished(spark, f"{path}/{table}", "batch=*") if _number(f) > upto]
    if later:
        parts.append((f"{path}/{table}", later))
    rows = spark.createDataFrame([], whole)
    for base, folders in parts:
        rows = rows.unionByName(spark.read.option("basePath", base).schema(whole).parquet(*folders).select(*whole.fieldNames()))
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def maintain_read_model(store_path: str, model_path: str, name: str = "model", buckets: int = MODEL_BUCKETS) -> Callable[[DataFrame, int], None]:
    """A handler that stores events and keeps the runs they touch up to date, reading only what concerns these.

    Three tables lie in buckets: events by the key they point with, starts by every key that leads to them, and the model's rows by run.
    A batch adds its own events and starts; the runs it touches are those its keys lead to, now or through a start that comes
    later; their events are read from the buckets of their keys only, and folded again. So the cost of a batch follows the
    runs it touches and not the history. A repeated batch replaces its own rows. ``buckets`` must stay what it was for a model.
    """

    def _bucketed(rows: DataFrame, by: str) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))

    def handle(good: DataFrame, batch_id: int) -> None:
        spark = good.sparkSession
        append_events(good, store_path, new_only=True, batch=f"{name}-{batch_id}")
        new = spark.read.schema(STORED_SCHEMA).parquet(f"{store_path}/batch={name}-{batch_id}").select(*EVENT_SCHEMA.fieldNames())
        pointing, starts = _bucketed(pointing_events(new).select(*POINTING), "link_key"), _bucketed(start_keys(new), "link_key")
        own = F.col("link_key") == F.col("run_id")  # a start's event lies under its run, its other keys lead there
        starts = starts.select(*[F.when(own, F.col(c)).alias(c) for c in EVENT_SCHEMA.fieldNames()], "run_id", "link_key", "bucket")
        _keep(pointing, model_path, "pointing", batch_id)
        _keep(starts, model_path, "starts", batch_id)

        def runs_with(keys: DataFrame) -> DataFrame:
            """Runs with a start, be it an old one, that some of the keys lead to."""
            found = _kept(spark, model_path, "starts", starts.schema, _touched(keys)).join(keys.select("link_key"), "link_key", "left_semi")
            return found.select("run_id").distinct()

        def starts_of(runs: DataFrame) -> DataFrame:
            """All start events of the runs."""
            found = _kept(spark, model_path, "starts", starts.schema, _touched(_bucketed(runs, "run_id"))).where("link_key = run_id")
            return found.join(runs, "run_id", "left_semi").select(*EVENT_SCHEMA.fieldNames())

        def keys_of(runs: DataFrame) -> DataFrame:
            return _bucketed(materialise(start_keys(starts_of(runs)).select("link_key").distinct(), "keys"), "link_key")

        # a start may take a key from another run or leave one to it, so runs that share keys are folded together
        written = [spark.read.schema("link_key string, bucket int").parquet(f"{model_path}/{table}/batch={batch_id}") for table in ("pointing", "starts")]
        named = materialise(written[0].unionByName(written[1]).distinct(), "named")
        runs = materialise(runs_with(named), "runs")
        runs = materialise(runs_with(keys_of(runs)).union(runs).distinct(), "runs")
        keys = keys_of(runs)
        latest = materialise(latest_starts(starts_of(materialise(runs_with(keys).union(runs).distinct(), "runs"))), "latest")
        seen = _kept(spark, model_path, "pointing", pointing.schema, _touched(keys))
        model = fold_runs(seen.drop("bucket", "batch"), latest, runs=runs)
        _keep(_bucketed(model, "run_id"), model_path, "model", batch_id)

    return handle


def _schemas(spark: SparkSession) -> dict[str, T.StructType]:
    """The columns of the model's three tables, besides those they lie in folders by."""
    none = spark.createDataFrame([], EVENT_SCHEMA)
    pointing = pointing_events(none).select(*POINTING)
    return {"pointing": pointing.schema, "starts": start_keys(none).schema, "model": fold_runs(pointing, latest_starts(none)).schema}


def current_read_model(spark: SparkSession, model_path: str) -> DataFrame:
    """The newest row of every run."""
    rows = _kept(spark, model_path, "model", _schemas(spark)["model"])
    rest = [c for c in rows.columns if c not in ("run_id", "batch", "bucket")]
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select("run_id", "_r.*")


def compact_read_model(spark: SparkSession, model_path: str) -> None:
    """Write the newest row of every run, and the events and starts of all batches, as one folder per table; run while no batch is being handled.

    A compaction is a folder of its own, named after the last batch it holds, and counts once it is whole; only then are the folders that it
    stands for removed. So it may die at any point: readers see the folders before it or the whole of it.
    """
    for table, schema in _schemas(spark).items():
        batches = finished(spark, f"{model_path}/{table}", "batch=*")
        if not batches:
            continue
        rows = _kept(spark, model_path, table, schema)
        if table == "model":
            rest = [c for c in rows.columns if c not in ("run_id", "batch")]
            rows = rows.groupBy("run_id").agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select("run_id", "_r.*")
        last = max(map(_number, batches))
        compact = f"{model_path}/{table}_compact"
        rows.drop("batch").hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{compact}/batch={last}")
        for folder in [*batches, *[f for f in finished(spark, compact, "batch=*") if _number(f) < last]]:
            delete_folder(spark, folder)


def distinct_events(stream: DataFrame, keys: Sequence[str], ts: str | None = None, watermark: str | None = None) -> DataFrame:
    """First row per key.

    Without a watermark every key ever seen is remembered, so repeats are found however late they come and the state grows with
    the keys. With one, a key is forgotten once its time is that far behind: repeats that come later than that pass again.
    """
    if watermark is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def tumbling(stream: DataFrame, ts: str, span: str, watermark: str, aggregates: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates per closed time span; rows later than the watermark are dropped and counted by Spark."""
    return buffer_tumbling(stream.withWatermark(ts, watermark), ts, span, aggregates, keys)


def write_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """A stream to files, exactly once."""
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
