"""Several live streams as one, each with a watermark of its own."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLICY = "spark.sql.streaming.multipleWatermarkPolicy"


def merge_streams(sources: Sequence[tuple[DataFrame, str]], ts: str, tag: str | None = None) -> DataFrame:
    """All rows of all sources (stream, watermark delay), duplicates kept; ``tag`` names a column holding the source's number.

    Every source has its own watermark, by its own rows and delay. What operators behind the merge go by is one of
    them: the slowest under the policy ``min``, so that nothing is dropped because another source is ahead, or the fastest under ``max``,
    so that nobody waits for a source that has fallen silent. See :func:`watermark_policy`.
    """
    marked = [s.withWatermark(ts, delay) for s, delay in sources]
    tagged = [s.withColumn(tag, F.lit(i)) for i, s in enumerate(marked)] if tag else marked
    return reduce(lambda a, b: a.unionByName(b), tagged)


@contextmanager
def watermark_policy(spark: SparkSession, policy: str) -> Iterator[None]:
    """Queries started inside go by the ``min`` or ``max`` of their sources' watermarks, also when they are restarted; the session is as before afterwards."""
    if policy not in ("min", "max"):
        raise ValueError("a policy is min or max")
    before = spark.conf.get(POLICY, None)
    spark.conf.set(POLICY, policy)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(POLICY)
        else:
            spark.conf.set(POLICY, before)
