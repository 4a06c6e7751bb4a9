"""A stored table with one row per key, kept in buckets so that a change costs what it touches.

Rows lie in folders by a hash of their key. An upsert reads the buckets of its keys, writes what they become beside the table (one
commit), and then replaces these buckets by dynamic partition overwrite; files of other buckets are not touched. If it dies in between, the
change that was written is applied by the next call, so readers who call :func:`read_keyed` see every change whole or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.plans.read_models import upsert
from ferrylog.sources.event_store import delete_folder, finished

BUCKETS, BUCKET = 64, "bucket"


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _waiting(spark: SparkSession, path: str) -> list[str]:
    return finished(spark, f"{path}_changes", "change=*")


def recover(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """Apply changes that were written but perhaps not applied; says how many. Applying one again changes nothing."""
    whole = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    waiting = _waiting(spark, path)
    for folder in waiting:
        rows = spark.read.schema(whole).parquet(folder)
        rows.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        delete_folder(spark, folder)
    return len(waiting)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows, after changes that were cut short have been applied."""
    recover(spark, path, schema)
    return _stored(spark, path, schema).drop(BUCKET)


def upsert_keyed(changes: DataFrame, path: str, key: str, as_of: Column, buckets: int = BUCKETS) -> None:
    """Insert or replace rows by key; ``created_at`` stays what it was, ``updated_at`` becomes ``as_of``.

    ``changes`` has one row per key; ``buckets`` must stay what it was for a table, and one writer changes it at a time. The same change with the same
    ``as_of`` again leaves every row as it is.
    """
    spark = changes.sparkSession
    schema = T.StructType([f for f in changes.schema.fields if f.name not in ("created_at", "updated_at")] + [T.StructField(c, T.TimestampType()) for c in ("created_at", "updated_at")])
    recover(spark, path, schema)
    # at most ``buckets`` numbers come to the driver
    touched = [r[BUCKET] for r in _bucketed(changes, key, buckets).select(BUCKET).distinct().collect()]
    current = _stored(spark, path, schema).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    after = upsert(current, changes.drop("created_at", "updated_at"), key, as_of.cast("timestamp"))
    folder = f"{path}_changes/change={uuid.uuid4().hex}"
    _bucketed(after.select(*schema.fieldNames()), key, buckets).write.parquet(folder)
    recover(spark, path, schema)
