"""Mix sources to target weights by Poisson replication.

A document of a group with mean repetition rate r is repeated k times, k the inverse of the Poisson(r) distribution at
a uniform number that is a hash of the seed and the document's id. Draws need no state: a retried task, another
partitioning or a later run draws the same. A second hash of seed, id and copy places each copy in the output, so the
shuffle is over the whole corpus, not within files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylog.llm.common import free_name

#: Uniform numbers have so many bits, so that they and the hash they come from are exact in a double.
BITS = 52
#: Where the distribution's tails are cut: beyond the resolution of the uniform numbers.
TAIL = 2.0**-60


def poisson_steps(rate: float) -> tuple[int, list[float]]:
    """``(k0, [P(X <= k0), P(X <= k0 + 1), ...])`` from where the distribution leaves 0 to where it reaches 1."""
    if rate <= 0:
        return 0, [1.0]
    mass = lambda k: math.exp(k * math.log(rate) - rate - math.lgamma(k + 1.0))
    k = max(0, int(rate - 12 * math.sqrt(rate) - 12))
    start, total, steps = k, 0.0, []
    while True:
        p = mass(k)
        total += p
        steps.append(min(total, 1.0))
        if k > rate and p < TAIL:
            return start, steps
        k += 1


def uniform(*parts: Column | str, seed: int) -> Column:
    """A number in [0, 1) from the hash of seed and parts; null parts count as empty."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(hashed, 1, BITS // 4), 16, 10).cast("long")


def repetition_rates(docs: DataFrame, weights: dict[str, float], rest: float, budget: float, source: str, size: Column) -> dict[str | None, float]:
    """Mean repetitions per group: its share of ``budget`` times the whole size, over its own size.

    Groups are the named sources and, under None, all others together (null sources among them). Shares are those of
    the groups that have any size. One row per group comes to the driver; groups are bounded by ``weights``.
    """
    group = F.when(F.col(source).isin(list(weights)), F.col(source))
    sizes = {r["g"]: r["n"] for r in docs.groupBy(group.alias("g")).agg(F.sum(size.cast("long")).alias("n")).collect() if r["n"]}
    share = {g: weights[g] if g is not None else rest for g in sizes}
    whole, total = sum(sizes.values()), sum(share.values())
    return {g: (share[g] / total) * (budget * whole) / n if total else 0.0 for g, n in sizes.items()}


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float],
    rest: float = 0.0,
    budget: float = 1.0,
    seed: int = 1,
    source: str = "source",
    doc_id: str = "doc_id",
    size: Column | None = None,
    copy: str = "mix_copy",
    key: str = "mix_key",
) -> DataFrame:
    """Documents repeated so that each source takes its weight's share of ``budget`` times the corpus, then shuffled.

    All columns of ``docs``, then ``mix_copy`` (1 to the number of repetitions) and ``mix_key`` (long): output partitions are
    ranges of ``mix_key`` and sorted by it, so that the files in their order are one random order of the whole mix.
    ``size`` measures a row (default: characters of ``text``); a group of size 0 is dropped. ``rest`` is the weight of
    all sources that ``weights`` does not name, null sources among them. Rows of one id share one draw, so exact
    repeats of a row are repeated alike; a null id counts as the empty id. An empty table gives an empty mix. Input
    columns named like those added (``copy``, ``key``) are replaced.
    """
    docs = docs.drop(copy, key)
    draw, number = free_name(docs, "_draw"), free_name(docs, "_number")
    size = F.coalesce(F.length("text"), F.lit(0)) if size is None else size
    rates = repetition_rates(docs, weights, rest, budget, source, size)
    scale = float(1 << BITS)
    drawn = uniform(doc_id, seed=seed) / F.lit(scale)

    def count(rate: float) -> Column:
        first, steps = poisson_steps(rate)
        above = F.size(F.filter(F.array(*[F.lit(x) for x in steps[:-1]]), lambda x: x <= F.col(draw))) if steps[:-1] else F.lit(0)
        return F.lit(first) + above

    copies = F.lit(0)
    for g, rate in rates.items():
        is_group = F.col(source) == g if g is not None else ~F.coalesce(F.col(source).isin(list(weights)), F.lit(False))
        copies = F.when(is_group, count(rate)).otherwise(copies)
    counted = docs.withColumn(draw, drawn).withColumn(number, copies).where(F.col(number) > 0).drop(draw)
    many = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(number)))).drop(number)
    keyed = many.withColumn(key, uniform(doc_id, copy, seed=seed + 1))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionById(parts, (F.col(key) / F.lit(scale) * parts).cast("int")).sortWithinPartitions(key, copy)
