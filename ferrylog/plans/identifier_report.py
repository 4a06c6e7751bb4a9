"""Identifier batches: transformation, statistics, recommendations, column scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.functions.identifiers import (
    FORMAT_DASHED,
    FORMAT_HEX,
    FORMAT_INVALID,
    transform_uuid,
    uuid_format,
)

# fixed values: milliseconds per identifier, batch size steps, invalid ones shown, advice texts
FEW, MANY = 100, 1000
SLOW_MS, FAST_MS = 0.1, 0.05
SMALL_BATCH, LARGE_BATCH = 100, 500
SHOWN = 10
HEX_ADVICE = "Found %d hex32 UUIDs (%.1f%%) - recommend transformation to standard format"
INVALID_ADVICE = "Found %d invalid UUIDs (%.1f%%) - require manual review"
STANDARD_ADVICE = "All UUIDs are already in standard format - no transformation needed"


def transform_batch(df: DataFrame, column: str, order: str, target: str = FORMAT_DASHED) -> DataFrame:
    """Each distinct value once, in order of first appearance (``first_seen``), transformed."""
    once = df.groupBy(column).agg(F.min(order).alias("first_seen"))
    return once.select("first_seen", transform_uuid(F.col(column), target).alias("_u")).select("first_seen", "_u.*")


def batch_statistics(transformed: DataFrame) -> DataFrame:
    """Totals over a transformed batch, with the count per format."""
    return transformed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_valid")).alias("successful"),
        F.count_if(~F.col("is_valid")).alias("failed"),
        *[F.count_if(F.col("format") == f).alias(f) for f in (FORMAT_DASHED, FORMAT_HEX, FORMAT_INVALID)],
    )


def recommendations(df: DataFrame, column: str) -> DataFrame:
    """Format counts, advice text and batch heuristics in one row; repeats count."""
    shape = uuid_format(F.col(column))
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(shape == f).alias(f) for f in (FORMAT_DASHED, FORMAT_HEX, FORMAT_INVALID)],
    )
    total, n_hex, n_bad = F.col("total"), F.col(FORMAT_HEX), F.col(FORMAT_INVALID)

    def share(n):
        return F.when(total > 0, n / total * 100).otherwise(F.lit(0.0))

    return counted.select(
        "*",
        F.when(n_hex > 0, F.format_string(HEX_ADVICE, n_hex, share(n_hex))).alias("hex_advice"),
        F.when(n_bad > 0, F.format_string(INVALID_ADVICE, n_bad, share(n_bad))).alias("invalid_advice"),
        F.when(F.col(FORMAT_DASHED) == total, STANDARD_ADVICE).alias("standard_advice"),
        (total * F.when(total <= FEW, F.lit(SLOW_MS)).otherwise(F.lit(FAST_MS))).alias("estimated_ms"),
        F.when(total <= FEW, total).when(total <= MANY, F.lit(SMALL_BATCH)).otherwise(F.lit(LARGE_BATCH)).cast("long").alias("batch_size"),
    )


def invalid_sample(df: DataFrame, column: str, order: str, rows: int = SHOWN) -> DataFrame:
    """The first invalid values: a report of ``rows`` lines."""
    return df.filter(uuid_format(F.col(column)) == FORMAT_INVALID).select(order, column).orderBy(order).limit(rows)


def scan_text_columns(df: DataFrame) -> DataFrame:
    """How many values of each text column look like a UUID, by format."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), uuid_format(F.col(c)).alias("format")) for c in texts])
    found = df.select(F.inline(cells)).filter(F.col("format") != FORMAT_INVALID)
    return found.groupBy("column", "format").agg(F.count(F.lit(1)).alias("values"))
