"""Events of a stream delivered to whoever subscribes to their type, while subscriptions change.

Subscriptions are a table of changes that may be written to at any time; each micro-batch goes by those that hold when it is first
tried, and a batch that is tried again by the same ones, so nobody gets an event twice or loses one by a retry. All
subscribers are served by one query: the batch is decoded once, joined to the subscriptions, and written to a folder per subscriber.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.functions.schemas import BOOL, MOMENT, TEXT, struct
from ferrylog.plans.read_models import route_events
from ferrylog.session import materialise
from ferrylog.sources.event_store import finished

CHANGE = struct(subscriber=TEXT, event_type=TEXT, active=BOOL, changed_at=MOMENT)
SUBSCRIPTION = struct(subscriber=TEXT, event_type=TEXT)


def change_subscription(spark: SparkSession, path: str, subscriber: str, event_types: Iterable[str], active: bool, at: Column | None = None) -> None:
    """Subscribe to (or, with ``active`` false, unsubscribe from) event types; the newest change of a pair holds."""
    when = F.current_timestamp() if at is None else at.cast("timestamp")
    rows = spark.createDataFrame([(subscriber, t, active) for t in event_types], T.StructType(CHANGE.fields[:3])).withColumn("changed_at", when)
    rows.coalesce(1).write.parquet(f"{path}/change={uuid.uuid4().hex}")


def subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """``subscriber, event_type`` of all pairs that hold now; of changes at one moment an unsubscription wins."""
    folders = finished(spark, path, "change=*")
    if not folders:
        return spark.createDataFrame([], SUBSCRIPTION)
    changes = spark.read.schema(CHANGE).parquet(*folders)
    newest = changes.groupBy("subscriber", "event_type").agg(F.max_by("active", F.struct("changed_at", ~F.col("active"))).alias("_active"))
    return newest.filter("_active").select("subscriber", "event_type")


def deliver(path: str, subscriptions_path: str, views: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Callable[[DataFrame, int], None]:
    """A handler that writes each good event of a batch for each of its subscribers, once.

    Deliveries lie under ``path`` in ``batch=<id>/subscriber=<name>``; a batch given again replaces its own. ``views`` names subscribers
    that get something made of their events instead (audit entries, notifications), under ``<path>_views/<name>/batch=<id>``.
    """

    def handle(good: DataFrame, batch_id: int) -> None:
        spark = good.sparkSession
        folder = f"{path}_subscriptions/batch={batch_id}"
        if not finished(spark, f"{path}_subscriptions", f"batch={batch_id}"):  # else: tried before, by these
            subscriptions(spark, subscriptions_path).coalesce(1).write.mode("overwrite").parquet(folder)
        wanted = spark.read.schema(SUBSCRIPTION).parquet(folder)
        routed = materialise(route_events(good, wanted), "routed")
        plain = routed if not views else routed.filter(~F.col("subscriber").isin(*views))
        plain.hint("rebalance", F.col("subscriber")).write.mode("overwrite").partitionBy("subscriber").parquet(f"{path}/batch={batch_id}")
        for name, view in (views or {}).items():
            view(routed.filter(F.col("subscriber") == name).drop("subscriber")).write.mode("overwrite").parquet(f"{path}_views/{name}/batch={batch_id}")

    return handle


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """All deliveries of finished batches, with ``subscriber`` and ``batch``."""
    folders = finished(spark, path, "batch=*")
    if not folders:
        return spark.createDataFrame([], SUBSCRIPTION)
    return spark.read.option("basePath", path).parquet(*folders)


def viewed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What a subscriber's view made of its events."""
    return spark.read.parquet(*finished(spark, f"{path}_views/{name}", "batch=*"))
