"""Segmented operators equal plain windows, whatever is hot."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrylog.operators import sequences
from ferrylog.operators.buffers import buffer_greedy
from ferrylog.operators.health import failure_runs, service_status
from ferrylog.operators.ordering import SEGMENT, framed, neighbours, running, with_segments, with_seq
from ferrylog.operators.skew import lookup_join, skew_join
from ferrylog.session import load_table

ORDER = ["ts", "event_id"]


@pytest.fixture(scope="module")
def skewed(spark, folder):
    """Half of all rows under one (NULL) key, a third at one moment, some without a time."""
    e = load_table(spark, folder.replace("sf0.001", "sf0.01"), "events")
    ts = (
        F.when(F.col("event_id") % 3 == 0, F.lit("2024-01-03 00:00:00").cast("timestamp"))
        .when(F.col("event_id") % 11 == 0, F.lit(None))
        .otherwise(F.col("ts"))
    )
    user = F.when(F.col("event_id") % 2 != 0, F.col("user_id"))
    return e.withColumns({"ts": ts, "user_id": user}).cache()


@pytest.fixture(scope="module")
def plain(skewed):
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return skewed.select(
        "event_id",
        F.row_number().over(w).alias("n"),
        F.row_number().over(Window.orderBy(*ORDER)).alias("g"),
        F.lag("value").over(w).alias("before"),
        F.lead("value").over(w).alias("after"),
        F.max("value").over(upto).alias("peak"),
        F.last(F.when(F.col("event_type") == "click", F.col("value")), True).over(upto).alias("click"),
        F.avg("value").over(w.rowsBetween(-9, 0)).alias("mean"),
    ).cache()


def differences(have, plain, condition):
    assert have.count() == plain.count()
    return have.join(plain, "event_id").filter(condition).count()


@pytest.mark.parametrize("target", [150, 400])
def test_with_seq(skewed, plain, target):
    keyed = with_seq(skewed, ORDER, ["user_id"], target_rows=target).select("event_id", "seq")
    assert differences(keyed, plain, "seq <> n") == 0
    whole = with_seq(skewed, ORDER, target_rows=target).select("event_id", "seq")
    assert differences(whole, plain, "seq <> g") == 0


@pytest.mark.parametrize("target", [150])
def test_segments_bound_their_size(skewed, target):
    for keys in ((), ("user_id",)):
        cut, split = with_segments(skewed, ORDER, keys, target)
        assert split
        assert cut.groupBy(*keys, SEGMENT).count().agg(F.max("count")).first()[0] <= 3 * target


def test_keys_that_share_a_long_beginning_are_cut(spark):
    rows = spark.range(20_000).selectExpr("concat('account-', lpad(id, 20, '0')) AS name", "id", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'k' END AS k")
    for keys in ((), ("k",)):
        cut, split = with_segments(rows, ["name"], keys, 500)
        sizes = cut.groupBy(SEGMENT).count().agg(F.max("count"), F.count("*")).first()
        assert split and sizes[0] <= 1500 and sizes[1] >= 30
    numbered = with_seq(rows, ["name"], ["k"], target_rows=500)
    wrong = numbered.filter("seq <> CASE WHEN k IS NULL THEN id DIV 3 + 1 ELSE id - id DIV 3 END")
    assert numbered.count() == 20_000 and wrong.count() == 0


def test_no_cut_when_small(skewed):
    assert with_segments(skewed, ORDER, ["user_id"])[1] is False


@pytest.mark.parametrize("target", [150])
def test_running_and_neighbours(skewed, plain, target):
    folds = {"p": ("max", F.col("value")), "c": ("last", F.when(F.col("event_type") == "click", F.col("value")))}
    run = running(skewed, folds, ORDER, ["user_id"], target).select("event_id", "p", "c")
    assert differences(run, plain, "p <> peak OR NOT (c <=> click)") == 0
    near = neighbours(skewed, ORDER, ["user_id"], {"b": F.col("value")}, {"a": F.col("value")}, target).select("event_id", "a", "b")
    assert differences(near, plain, "NOT (a <=> after) OR NOT (b <=> before)") == 0


def test_framed(skewed, plain):
    numbered = with_seq(skewed, ORDER, ["user_id"], target_rows=300)
    have = framed(numbered, {"m": (F.avg("value"), -9, 0)}, ["user_id"], 9, block_rows=25).select("event_id", "m")
    assert differences(have, plain, "abs(m - mean) > 1e-9") == 0


def timed(skewed):
    return skewed.filter(F.col("ts").isNotNull())


def both(operator, skewed, columns):
    """The same operator cut into many segments and not cut at all."""
    a = operator(200).select("event_id", *columns).toPandas().sort_values("event_id").reset_index(drop=True)
    b = operator(10**9).select("event_id", *columns).toPandas().sort_values("event_id").reset_index(drop=True)
    assert len(a) == len(b) > 0
    return a, b


@pytest.mark.parametrize("span", [600, 7200, 86400, 864_000])
def test_greedy_buffer_is_the_sequential_rule(skewed, span):
    rows = timed(skewed).select("event_id", "user_id", "ts")
    a, b = both(lambda t: buffer_greedy(rows, "ts", span, ORDER, ["user_id"], t), skewed, ["buffer_id", "closes"])
    assert a.equals(b)
    hot = rows.filter("user_id IS NULL").toPandas().sort_values(ORDER).reset_index(drop=True)
    last, number, want = hot.ts[0], 0, []
    for ts in hot.ts:
        closes = (ts - last).total_seconds() >= span
        want.append((number, closes))
        if closes:
            last, number = ts, number + 1
    found = a.set_index("event_id").loc[hot.event_id]
    assert list(zip(found.buffer_id, found.closes)) == want


@pytest.mark.parametrize("span", [0.000001, 3600, 86400, 400_000, 5_000_000])
def test_greedy_buffer_without_keys(skewed, span):
    """Segments of some 50 rows: the spans are shorter and much longer than these, and longer than all rows together."""
    rows = timed(skewed).filter("event_id % 20 < 3").select("event_id", "ts")
    found = buffer_greedy(rows, "ts", span, ORDER, (), 50).toPandas().sort_values(ORDER)
    last, number, want = found.ts.iloc[0], 0, []
    for ts in found.ts:
        closes = (ts - last).total_seconds() >= span
        want.append((number, closes))
        if closes:
            last, number = ts, number + 1
    assert list(zip(found.buffer_id, found.closes)) == want and len(want) > 1000


def test_greedy_buffer_needs_a_span(skewed):
    with pytest.raises(ValueError):
        buffer_greedy(skewed, "ts", 0, ORDER)


def test_throttle_is_the_sequential_rule(skewed):
    rows = timed(skewed)
    a, b = both(lambda t: sequences.throttle(rows, "ts", 3600, ORDER, ["user_id"], t), skewed, ["emit_us"])
    assert a.equals(b)
    hot = rows.filter("user_id IS NULL").select("event_id", F.unix_micros("ts").alias("us")).toPandas().sort_values(["us", "event_id"])
    emit, want = None, []
    for us in hot.us:
        emit = us if emit is None else max(us, emit + 3_600_000_000)
        want.append(emit)
    assert list(a.set_index("event_id").loc[hot.event_id].emit_us) == want


def test_ema_is_the_sequential_rule(skewed):
    a, _ = both(lambda t: sequences.moving_average_exponential(skewed, "value", ORDER, ["user_id"], 0.1, t), skewed, ["ema"])
    order = with_seq(skewed.filter("user_id IS NULL"), ORDER).select("event_id", "value", "seq").toPandas().sort_values("seq")
    ema, want = None, []
    for value in order.value:
        ema = value if ema is None else 0.1 * value + 0.9 * ema
        want.append(ema)
    found = a.set_index("event_id").loc[order.event_id].ema
    assert max(abs(x - y) for x, y in zip(found, want)) < 1e-9


@pytest.mark.parametrize(("alpha", "block"), [(0.0, 100_000), (1.0, 100_000), (1e-6, 50), (1e-6, 100_000), (0.3, 7), (0.02, 3)])
def test_ema_of_any_alpha_and_nulls(skewed, alpha, block):
    df = skewed.withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    made = sequences.moving_average_exponential(df, "value", ORDER, ["user_id"], alpha, 200, block).select("event_id", "ema").toPandas().set_index("event_id")
    rows = with_seq(df.filter("user_id IS NULL"), ORDER).select("event_id", "value", "seq").toPandas().sort_values("seq")
    ema = None
    for event, value in zip(rows.event_id, rows.value):
        if value == value:
            ema = value if ema is None else alpha * value + (1 - alpha) * ema
        have = made.loc[event].ema
        assert (have != have) if ema is None else abs(have - ema) <= 1e-9 * max(1.0, abs(ema))
    with pytest.raises(ValueError, match="alpha"):
        sequences.moving_average_exponential(df, "value", ORDER, alpha=1.5)


def test_health_rules(skewed):
    ok = F.col("event_type") != "error"
    a, b = both(lambda t: failure_runs(skewed, ok, ORDER, ["user_id"], t), skewed, ["consecutive_failures"])
    assert a.equals(b)
    a, b = both(lambda t: service_status(skewed, ok, ORDER, ["user_id"], 2, t), skewed, ["status"])
    assert a.equals(b)
    order = with_seq(skewed.filter("user_id IS NULL"), ORDER).select("event_id", "event_type", "seq").toPandas().sort_values("seq")
    failures, status, want = 0, "unknown", []
    for kind in order.event_type:
        failures = failures + 1 if kind == "error" else 0
        status = "healthy" if failures == 0 else "unhealthy" if failures >= 2 else status
        want.append(status)
    assert list(a.set_index("event_id").loc[order.event_id].status) == want


def test_other_operators_when_cut(skewed):
    rows = timed(skewed)
    for operator in (
        lambda t: sequences.debounce(rows, "ts", 600, ORDER, ["user_id"], t),
        lambda t: sequences.distinct_until_changed(rows, F.col("event_type"), ORDER, ["user_id"], t),
        lambda t: sequences.batch(rows, 7, ORDER, ["user_id"], t),
        lambda t: sequences.keep_newest(rows, 1500, ORDER, ["user_id"], t),
        lambda t: sequences.skip(rows, 500, ORDER, t),
        lambda t: sequences.sliding_window(rows, 5, ORDER, 3, t).filter("pos = 0"),
    ):
        a, b = both(operator, skewed, ["event_type"])
        assert a.equals(b)


def test_sessions_when_cut(skewed):
    def sessions(target):
        made = sequences.buffer_session(timed(skewed), "ts", 3600, {"n": F.count(F.lit(1))}, ["user_id"], target)
        return sorted(map(tuple, made.collect()), key=str)

    assert sessions(200) == sessions(10**9)


def test_joins_spread_hot_keys(spark, skewed):
    rows = skewed.select("event_id", "user_id")
    names = rows.select("user_id").distinct().withColumn("name", F.concat(F.lit("n"), "user_id")).filter("user_id % 3 <> 0")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, rows.join(names, "user_id", how).select("event_id").collect()))
        for made in (
            lookup_join(rows, names, ["user_id"], ["event_id"], how),
            lookup_join(rows, names, ["user_id"], ["event_id"], how, max_broadcast=5, min_rows=20),
            skew_join(rows, names, ["user_id"], ["event_id"], how, min_rows=20),
        ):
            assert sorted(map(str, made.select("event_id").collect())) == want
