from __future__ import annotations

import math

import __spark_entry__ as entries
from ferrylog.llm import mixing
from tools.check import compare, connect


def test_steps_are_the_distribution():
    for rate in (0.01, 1.0, 7.5, 300.0, 5000.0):
        first, steps = mixing.poisson_steps(rate)
        mean = sum((first + i) * (c - (steps[i - 1] if i else 0.0)) for i, c in enumerate(steps))
        assert math.isclose(mean, rate, rel_tol=1e-9) and math.isclose(steps[-1], 1.0, abs_tol=1e-9)
    assert mixing.poisson_steps(0.0) == (0, [1.0])


def test_shares_and_order(spark):
    rows = [(i, "x" * 10, "a" if i % 3 else "b") for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix_sources(df, {"a": 1.0, "b": 3.0}, seed=3)
    n = {r.source: r["count"] for r in mix.groupBy("source").count().collect()}
    assert abs(n["b"] / sum(n.values()) - 0.75) < 0.01 and abs(sum(n.values()) - 30_000) < 1000
    keys = [r.mix_key for r in mix.collect()]
    assert keys == sorted(keys)
    assert mix.groupBy("doc_id").agg({"mix_copy": "max", "*": "count"}).where("`max(mix_copy)` != `count(1)`").count() == 0


def test_odd_rows(spark):
    rows = [(1, None, None, 5, 7), (1, None, None, 5, 7), (None, "", "a", 1, 1), (2, "abc", "z", 1, 1), (3, "abc", "a", 1, 1)] + [(i, "abcd", None, 0, 0) for i in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copy long, _draw long")
    out = mixing.mix_sources(df, {"a": 1.0, "absent": 5.0}, rest=2.0, seed=3)
    assert out.columns == ["doc_id", "text", "source", "_draw", "mix_copy", "mix_key"]
    per = {tuple(r) for r in out.where("doc_id = 1").groupBy("mix_copy").count().select("count").collect()}
    assert per in (set(), {(2,)})  # repeats of a row share their draw
    assert out.where("source is null").count() > 0
    assert mixing.mix_sources(df.limit(0), {"a": 1.0}).collect() == []
    assert mixing.mix_sources(df, {"a": 1.0}, rest=0.0).where("source is null or source = 'z'").count() == 0


def test_query(spark, folder):
    have = entries.queries()["op9_mix_sources"](spark, folder).toPandas()
    assert compare(have, connect(folder).execute(entries.oracle_sql()["op9_mix_sources"]).df()) is None
