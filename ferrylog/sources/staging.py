"""Staged JSON sets and the target tables, as Parquet folders or over JDBC."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ISO_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
JDBC_BATCH_ROWS = 5_000


def write_staged(sets: dict[str, DataFrame], folder: str) -> None:
    """One JSON folder per entity; timestamps as ISO text."""
    for name, df in sets.items():
        df.write.mode("overwrite").options(**ISO_OPTIONS).json(os.path.join(folder, name))


def read_staged(spark: SparkSession, folder: str, schemas: dict[str, T.StructType | str]) -> dict[str, DataFrame]:
    """Read every named set back with its declared schema; a missing set is an error."""
    return {
        name: spark.read.schema(schema).options(timestampFormat=ISO_OPTIONS["timestampFormat"]).json(os.path.join(folder, name))
        for name, schema in schemas.items()
    }


def reset_table(spark: SparkSession, path: str, schema: T.StructType, drop_first: bool = False) -> None:
    """Create an empty table; an existing one is kept unless ``drop_first`` is set."""
    spark.createDataFrame([], schema).write.mode("overwrite" if drop_first else "ignore").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", partitions: int | None = None, **options: str) -> None:
    """Write to a database; ``partitions`` bounds how many connections write at once."""
    out = df.coalesce(partitions) if partitions else df
    out.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(JDBC_BATCH_ROWS), **options).mode(mode).save()


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 16,
    **options: str,
) -> DataFrame:
    """Read a table; with a numeric split column and its bounds, in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_column and bounds:
        reader = reader.options(
            partitionColumn=split_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)
        )
    return reader.load()
