"""Row-wise and set operators: map, filter, flat map, validate, reduce, merge, take."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce as _reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUCCESS_LIMIT = 0.1  # fixed value: healthy below this failure rate


def map_rows(df: DataFrame, columns: dict[str, Column], error: Column | None = None) -> DataFrame:
    """Item to item. Rows for which ``error`` is not NULL are dropped; use ``try_*`` functions inside."""
    good = df if error is None else df.filter(error.isNull())
    return good.select(*[c.alias(n) for n, c in columns.items()])


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; NULL is not true."""
    return df.filter(predicate)


def flat_map(df: DataFrame, items: Column, item: str = "item", position: str | None = None) -> DataFrame:
    """One row per element of an array column; an empty or NULL array yields no row."""
    if position:
        return df.select("*", F.posexplode(items).alias(position, item))
    return df.withColumn(item, F.explode(items))


def map_batches(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """A Python function over Arrow batches, for mappings no column expression can state.

    A batch that raises is halved until only the failing rows are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            waiting = [batch]
            while waiting:
                part = waiting.pop()
                try:
                    out = function(part)
                except Exception:
                    half = len(part) // 2
                    if half:
                        waiting += [part.iloc[half:], part.iloc[:half]]
                    continue
                yield out

    return df.mapInPandas(run, schema)


def split_valid(df: DataFrame, is_valid: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, failed rows); a NULL verdict is a failure."""
    verdict = F.coalesce(is_valid, F.lit(False))
    return df.filter(verdict), df.filter(~verdict)


def validation_metrics(df: DataFrame, is_valid: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows done and failed, failure rate over done, and the healthy flag."""
    verdict = F.coalesce(is_valid, F.lit(False))
    counts = df.groupBy(*keys).agg(
        F.count_if(verdict).alias("completed"),
        F.count_if(~verdict).alias("failed"),
    )
    rate = F.col("failed") / F.greatest(F.col("completed"), F.lit(1))
    return counts.withColumn("failure_rate", rate).withColumn("healthy", rate < SUCCESS_LIMIT)


def reduce_rows(df: DataFrame, folds: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Fold to one value (per key) with associative aggregates: partial before the shuffle, final after."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in folds.items()])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key. Aggregated before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def merge(*sources: DataFrame, tag: str | None = None) -> DataFrame:
    """All rows of all inputs, duplicates kept; ``tag`` names a column holding the input's number."""
    marked = [s.withColumn(tag, F.lit(i)) if tag else s for i, s in enumerate(sources)]
    return _reduce(lambda a, b: a.unionByName(b), marked)


def take(df: DataFrame, count: int, order: Sequence[str | Column]) -> DataFrame:
    """The first rows in order: a top-n report, kept per task before one small merge."""
    return df.orderBy(*order).limit(count)
