"""Positions that go on over micro-batches: batches, sliding windows, skips and zips of a stream are then those of the whole.

Per micro-batch the only state is the number of rows before it, a row in a folder named after the batch, and, where windows need
them, the last rows. A batch that is given again starts from the end of the one before it, as it did the first time,
and replaces what it wrote; so its numbers are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.functions.schemas import LONG, struct
from ferrylog.operators.ordering import TARGET_ROWS, with_seq
from ferrylog.session import materialise
from ferrylog.sources.event_store import finished

END = struct(rows=LONG)


def _batch_of(folder: str) -> int:
    return int(folder.rsplit("batch=", 1)[1])


def _before(spark: SparkSession, path: str, batch_id: int) -> tuple[int, int | None]:
    """How many rows the finished batches before one had, and the last of these batches."""
    earlier = [b for b in map(_batch_of, finished(spark, f"{path}/ends", "batch=*")) if b < batch_id]
    if not earlier:
        return 0, None
    last = max(earlier)
    return spark.read.schema(END).parquet(f"{path}/ends/batch={last}").first()["rows"], last


def numbered(
    handle: Callable[[DataFrame, int], None],
    path: str,
    order: Sequence[str],
    keep: int = 0,
    name: str = "seq",
    target_rows: int = TARGET_ROWS,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that numbers the rows of a stream 1, 2, 3 ... over all its batches, and hands them on.

    Within a batch rows are numbered by ``order`` (whose last column tells rows apart); batches follow each other as they come. ``handle`` gets the
    rows with ``name``, and before them the ``keep`` rows that came last (none yet handed on has a smaller number than its place
    says). ``handle`` must replace what it wrote for a batch of the same id. The batch's end is written last, so a batch that failed counts
    for nothing. ``path`` holds the ends, one small row per batch, and belongs to one stream.
    """

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        start, last = _before(spark, path, batch_id)
        own = materialise(with_seq(rows, order, name=name, target_rows=target_rows).withColumn(name, F.col(name) + start), "numbered")
        whole = own
        if keep and last is not None:
            whole = spark.read.schema(own.schema).parquet(f"{path}/tail/batch={last}").unionByName(own)
        handle(whole, batch_id)
        end = start + own.count()
        if keep:
            whole.filter(F.col(name) > end - keep).write.mode("overwrite").parquet(f"{path}/tail/batch={batch_id}")
        spark.createDataFrame([(end,)], END).coalesce(1).write.mode("overwrite").parquet(f"{path}/ends/batch={batch_id}")

    return on_batch


def keep_rows(path: str, name: str = "seq") -> Callable[[DataFrame, int], None]:
    """A handler that stores numbered rows; see :func:`kept_rows`."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def kept_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`keep_rows` has stored; unfinished batches are not read."""
    folders = finished(spark, path, "batch=*")
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def keep_windows(path: str, size: int, step: int = 1, name: str = "seq") -> Callable[[DataFrame, int], None]:
    """A handler that stores the full sliding windows which a batch completes: each row once per window, with ``window_id`` and ``pos``.

    Use it with ``numbered(..., keep=size - 1)``: a window that began in an earlier batch is whole then. Window k covers the numbers k * step + 1 to
    k * step + size.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        bounds = rows.agg(F.min(name).alias("low"), F.max(name).alias("high")).first()
        back = F.col(name) - 1
        first = F.greatest(F.ceil((back - (size - 1)) / step), F.lit(0)).cast("long")
        last = F.floor(back / step).cast("long")
        each = rows.withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
        begin, end = F.col("window_id") * step + 1, F.col("window_id") * step + size
        low, high = (bounds["low"], bounds["high"]) if bounds["low"] is not None else (1, 0)
        whole = each.filter((begin >= low) & (end <= high)).withColumn("pos", F.col(name) - begin)
        whole.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle
