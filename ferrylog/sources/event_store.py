"""The event table, transaction logs and the processing log on files."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.functions.payloads import object_or_empty, payload_fields
from ferrylog.functions.schemas import INT, LONG, MOMENT, TEXT, struct
from ferrylog.plans.event_model import EVENT_ORDER, EVENT_SCHEMA

STORED_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("event_date", T.DateType())])
PROCESSING_LOG_SCHEMA = struct(
    event_id=TEXT, handler_name=TEXT, processing_status=TEXT, processing_time_ms=INT, error_message=TEXT, processed_at=MOMENT,
)
OPERATION = struct(
    operation_id=TEXT, operation_type=TEXT, target_table=TEXT, operation_data=TEXT, rollback_data=TEXT, timestamp=TEXT,
)
CHECKPOINT = struct(checkpoint_id=TEXT, transaction_id=TEXT, operation_count=LONG, checkpoint_data=TEXT, timestamp=TEXT)
TRANSACTION_SCHEMA = struct(
    transaction_id=TEXT, status=TEXT, start_time=TEXT, end_time=TEXT, metadata=T.MapType(TEXT, TEXT),
    operations=T.ArrayType(OPERATION), checkpoints=T.ArrayType(CHECKPOINT),
)


#: The index of stored ids lies in so many folders by a hash of the id.
ID_BUCKETS = 64
ID_SCHEMA = struct(event_id=TEXT)


#: A batch that stands for others is named so; what it stands for is written before it.
MERGED, MERGE = "merged-", struct(name=TEXT)


def _bucket(event_id: str) -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(ID_BUCKETS)).cast("int")


def finished(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """The folders under a path whose write has ended."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(x.getPath().getParent().toString() for x in found or [])


def _batches(spark: SparkSession, path: str, but: str | None = None) -> list[str]:
    """The finished batches of a store or its index, by their folders; those that a finished merge stands for are left out."""
    folders = {f.rsplit("/batch=", 1)[1]: f for f in finished(spark, path, "batch=*")}
    replaced = {but}
    for name in folders:
        if name.startswith(MERGED):
            replaced |= {r["name"] for r in spark.read.schema(MERGE).parquet(f"{path.removesuffix('_ids')}_merged/{name}").collect()}
    return [folder for name, folder in folders.items() if name not in replaced]


def stored_ids(spark: SparkSession, path: str, buckets: list[int], but: str | None = None) -> DataFrame:
    """Ids in the given buckets of a store's index, those of one batch left out."""
    folders = _batches(spark, f"{path}_ids", but)
    if not folders:
        return spark.createDataFrame([], ID_SCHEMA)
    index = spark.read.option("basePath", f"{path}_ids").schema(T.StructType([*ID_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])).parquet(*folders)
    return index.where(F.col("bucket").isin(buckets)).select("event_id")


#: Ids that look-ups ask for: row groups that hold none of them are skipped by Bloom filters as large as their ids need.
LOOKED_UP = ("correlation_id", "aggregate_id")
BLOOM = {"parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKED_UP}


def content_name(events: DataFrame) -> str:
    """A name that depends on the events of a batch and nothing else, whatever their order; one pass over them."""
    row = F.xxhash64(*events.columns)
    found = events.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit((1 << 31) - 1))).alias("s")).first()
    return f"{found['n']}-{(found['x'] or 0) & (1 << 64) - 1:016x}-{found['s'] or 0:x}"


def append_events(events: DataFrame, path: str, new_only: bool = False, batch: str | None = None) -> None:
    """Append a batch of events by day, sorted within files so that reads by aggregate skip row groups.

    An event's id is its key. With ``new_only`` an id that other batches have stored is left out, whatever its time; of an id that
    repeats within the batch the first by ``EVENT_ORDER`` stays. Only the buckets of the id index that the batch touches are
    read. A batch given under the same name again replaces its own folder, and a batch without a name is named after its content, so a retry
    adds nothing, wherever the first try ended; events are written before their ids, and readers see finished batches only. Two writers who
    store the same id at the same time are not kept apart.
    """
    spark = events.sparkSession
    if not (new_only or batch):
        _write_ids(spark, path, _write_named(events, path))
        return
    rows, batch = events, batch or content_name(events)
    if new_only:
        first = F.min_by(F.struct(*[F.col(c) for c in events.columns]), F.struct(*EVENT_ORDER))
        rows = events.groupBy("event_id").agg(first.alias("_e")).select("_e.*")
        # at most ID_BUCKETS numbers come to the driver
        touched = [r["b"] for r in events.select(_bucket("event_id").alias("b")).distinct().collect()]
        rows = rows.join(stored_ids(spark, path, touched, batch), "event_id", "left_anti")
    _write_events(rows.withColumn("event_date", F.to_date("timestamp")), f"{path}/batch={batch}")
    _write_ids(spark, path, batch)


def _write_events(rows: DataFrame, folder: str) -> None:
    rows = rows.hint("rebalance", F.col("event_date"))  # few files per day, and a hot day is split
    rows.sortWithinPartitions("event_date", "aggregate_id", "event_version").write.mode("overwrite").options(**BLOOM).partitionBy("event_date").parquet(folder)


def _write_named(events: DataFrame, path: str) -> str:
    """Write a batch and then name it after what was written, so that the events are made once; says the name.

    It is written beside the store and moved there; its mark of being finished comes last.
    """
    spark, staged = events.sparkSession, f"{path}_staged/{uuid.uuid4().hex}"
    _write_events(events.withColumn("event_date", F.to_date("timestamp")), staged)
    name = content_name(spark.read.schema(T.StructType([*events.schema.fields, STORED_SCHEMA["event_date"]])).parquet(staged).select(*events.columns))
    if finished(spark, path, f"batch={name}"):  # the same events, stored before
        delete_folder(spark, staged)
        return name
    path_of, folder = spark._jvm.org.apache.hadoop.fs.Path, f"{path}/batch={name}"
    files = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    delete_folder(spark, folder)  # what a try that died has left
    files.mkdirs(path_of(path))
    files.delete(path_of(f"{staged}/_SUCCESS"), False)
    if not files.rename(path_of(staged), path_of(folder)):
        raise OSError(f"cannot move {staged} to {folder}")
    files.create(path_of(f"{folder}/_SUCCESS"), True).close()
    return name


def _write_ids(spark: SparkSession, path: str, batch: str) -> None:
    ids = spark.read.schema(STORED_SCHEMA).parquet(f"{path}/batch={batch}").select("event_id", _bucket("event_id").alias("bucket")).hint("rebalance", F.col("bucket"))
    ids.sortWithinPartitions("bucket", "event_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}_ids/batch={batch}")


def compact_events(spark: SparkSession, path: str) -> int:
    """Merge the finished batches of a store into one, and their ids; run while no batch is being appended. Says how many batches there were.

    What the merge stands for is written first, so the moment it is finished readers leave its parts out; these are removed last. It may die at any
    point and be run again: events are read once, from the parts or from the merge.
    """
    parts, ids = _batches(spark, path), _batches(spark, f"{path}_ids")
    names = sorted({f.rsplit("/batch=", 1)[1] for f in [*parts, *ids]})
    if len(names) > 1:
        merged = f"{MERGED}{uuid.uuid4().hex}"
        spark.createDataFrame([(n,) for n in names], MERGE).coalesce(1).write.parquet(f"{path}_merged/{merged}")
        _write_events(spark.read.option("basePath", path).schema(STORED_SCHEMA).parquet(*parts).select(*STORED_SCHEMA.fieldNames()), f"{path}/batch={merged}")
        _write_ids(spark, path, merged)
    current = {f.rsplit("/", 1)[1] for f in _batches(spark, path)}
    for place in (path, f"{path}_ids"):
        for folder in finished(spark, place, "batch=*"):
            if folder.rsplit("/", 1)[1] not in current:
                delete_folder(spark, folder)
    for folder in finished(spark, f"{path}_merged", f"{MERGED}*"):
        if f"batch={folder.rsplit('/', 1)[1]}" not in current:
            delete_folder(spark, folder)
    return len(names)


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events of finished batches."""
    folders = _batches(spark, path)
    if not folders:
        return spark.createDataFrame([], STORED_SCHEMA)
    return spark.read.option("basePath", path).schema(STORED_SCHEMA).parquet(*folders).select(*STORED_SCHEMA.fieldNames())


def events_after(spark: SparkSession, path: str, at: datetime | None, event_id: str | None, until: datetime | None = None) -> DataFrame:
    """Events of finished batches behind a place in ``EVENT_ORDER``, up to and with a moment; folders of days before it are not read."""
    events, when = read_events(spark, path), F.col("timestamp")
    if at is not None:
        mark = F.lit(at).cast("timestamp")
        events = events.filter((F.col("event_date") >= F.to_date(mark)) & ((when > mark) | ((when == mark) & (F.col("event_id") > F.lit(event_id)))))
    if until is not None:
        last = F.lit(until).cast("timestamp")
        events = events.filter((F.col("event_date") <= F.to_date(last)) & (when <= last))
    return events


def decode_events(stored: DataFrame) -> DataFrame:
    """Payload and metadata text as maps of name to JSON text; text that is no object gives an empty map."""
    return stored.withColumns(
        {
            "data": payload_fields(object_or_empty(F.col("event_data"))),
            "metadata": payload_fields(object_or_empty(F.col("event_metadata"))),
        }
    )


def write_transactions(log: DataFrame, path: str) -> None:
    """One JSON object per transaction."""
    log.write.mode("append").json(path)


def read_transactions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Transaction files; nested payloads arrive as JSON text."""
    return spark.read.schema(TRANSACTION_SCHEMA).option("multiLine", multi_line).json(path)


def processing_log(judged: DataFrame, handler: str, error: str = "error", milliseconds: str | None = None, as_of=None) -> DataFrame:
    """One row per handled event: processed, or failed with the message."""
    failed = F.col(error).isNotNull()
    when = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    return judged.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.lit(handler).alias("handler_name"),
        F.when(failed, "failed").otherwise("processed").alias("processing_status"),
        (F.col(milliseconds) if milliseconds else F.lit(None)).cast("int").alias("processing_time_ms"),
        F.col(error).alias("error_message"),
        when.alias("processed_at"),
    )
