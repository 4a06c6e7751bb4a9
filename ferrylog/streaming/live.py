"""Live figures of running streams: what each micro-batch did, failed at and came too late for, as rows of a table.

Rows are counted on their way by ``DataFrame.observe``, so counting costs no pass of its own; a listener adds what Spark knows of the batch
(rows that a watermark dropped, time taken) and writes one row per finished batch, named after query and batch.
"""

from __future__ import annotations

import threading

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ferrylog.functions.schemas import DOUBLE, LONG, TEXT, struct
from ferrylog.operators.rows import SUCCESS_LIMIT

COUNTS = "live_counts"
LIVE = struct(run_id=TEXT, name=TEXT, at=TEXT, rows=LONG, completed=LONG, failed=LONG, late=LONG, seconds=DOUBLE)


def counted(stream: DataFrame, done: Column) -> DataFrame:
    """The stream itself, its rows counted on the way: those for which ``done`` holds, and the others (a null verdict is a failure)."""
    verdict = F.coalesce(done, F.lit(False))
    return stream.observe(COUNTS, F.count(F.lit(1)).alias("rows"), F.count_if(verdict).alias("completed"), F.count_if(~verdict).alias("failed"))


class LiveCounts(StreamingQueryListener):
    """Writes a row per finished micro-batch of every query that starts while it listens.

    A row lies in the folder ``query=<id>/batch=<number>``, so a batch that is run again after a restart replaces its row. ``late`` are rows that
    stateful operators dropped for the watermark: rows of the input where such an operator takes these, partial groups where rows are
    aggregated before they reach it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._ended: dict[str, threading.Event] = {}

    def _end_of(self, run_id: str) -> threading.Event:
        return self._ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end_of(event.runId)

    def onQueryProgress(self, event) -> None:
        done = event.progress
        seen = done.observedMetrics.get(COUNTS)
        counts = [seen[c] or 0 for c in ("rows", "completed", "failed")] if seen is not None else [done.numInputRows, None, None]
        late = sum(op.numRowsDroppedByWatermark for op in done.stateOperators)
        row = (str(done.runId), done.name, done.timestamp, *counts, late, done.durationMs.get("triggerExecution", 0) / 1000)
        folder = f"{self.path}/query={done.id}/batch={done.batchId}"
        self.spark.createDataFrame([row], LIVE).coalesce(1).write.mode("overwrite").parquet(folder)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(event.runId).set()  # events come in order, so all rows of the run are written

    def watch(self, query: StreamingQuery, seconds: float = 60.0) -> bool:
        """Wait until the query has ended and its last row is written."""
        query.awaitTermination()
        return self._end_of(query.runId).wait(seconds)


def live_counts(spark: SparkSession, path: str) -> DataFrame:
    """What has been written so far: ``query, batch`` and the columns of :data:`LIVE`."""
    whole = T.StructType([*LIVE.fields, T.StructField("query", T.StringType()), T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def live_metrics(counts: DataFrame) -> DataFrame:
    """Per query: batches, rows done and failed, rows too late, failure rate over done, the healthy flag, rows per second."""
    totals = counts.groupBy("query", "name").agg(
        F.count(F.lit(1)).alias("batches"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("rows", "completed", "failed", "late")],
        F.sum("seconds").alias("seconds"),
    )
    rate = F.col("failed") / F.greatest(F.col("completed"), F.lit(1))
    return totals.withColumns({"failure_rate": rate, "healthy": rate < SUCCESS_LIMIT, "rows_per_second": F.when(F.col("seconds") > 0, F.col("rows") / F.col("seconds"))})
