"""Keys dealt to buckets: each key's values are its own, whatever else lies in its bucket."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ferrylog.streaming import consumers, stateful

BIG = 2**53  # a long that a double cannot tell from the next one


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STATE_PROVIDER)


def streamed(spark, tmp_path, parts, build):
    """What a stream of one part per trigger gives."""
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = build(spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    consumers.write_files(stream, str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def history():
    """Rows of 40 keys, one of them null, in order of time; some longs are null, others need all their bits."""
    rng = random.Random(5)
    return [(rng.choice([None, *range(BIG, BIG + 39)]), None if i % 3 == 0 else BIG + i, i * 3600 + rng.randrange(3000), float(rng.randrange(4)), rng.random() < 0.4) for i in range(800)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, id long, s long, v double, ok boolean").withColumn("ts", F.timestamp_seconds("s"))


def test_sequences_of_keys_in_few_buckets(spark, tmp_path):
    rows = history()
    shuffled = [random.Random(n).sample(part, len(part)) for n, part in enumerate((rows[:300], rows[300:]))]
    parts = [frame(spark, part) for part in shuffled]
    have = streamed(spark, tmp_path, parts, lambda s: stateful.with_sequence_state(s, "k", "v", "ok", ["ts"], buckets=3))
    want, states = [], {}
    for k, i, s, v, ok in rows:
        seq, last, total, ema, failures, status = states.get(k, (0, None, 0.0, None, 0, "unknown"))
        failures = 0 if ok else failures + 1
        status = "healthy" if ok else "unhealthy" if failures >= stateful.UNHEALTHY_AFTER else status
        ema = v if ema is None else 0.1 * v + 0.9 * ema
        states[k] = (seq + 1, v, total + v, ema, failures, status)
        want.append((s, k, i, seq + 1, v != last, total + v, round(ema, 9), failures, status))
    found = [(r.s, r.k, r.id, r.seq, r.changed, r.total, round(r.ema, 9), r.consecutive_failures, r.status) for r in have]
    assert sorted(found, key=lambda r: r[0]) == want


def test_greedy_buffers_of_keys_in_few_buckets(spark, tmp_path):
    rows = history()
    mark = [(-1, -1, rows[-1][2] + 10**7, 0.0, True)]
    parts = [frame(spark, part) for part in (rows[:300] + rows[310:320], rows[300:310] + rows[320:], mark)]
    build = lambda s: stateful.buffer_greedy_stream(s, "ts", 86400, "1 day", ["id"], ["k"], buckets=3)
    have = [r for r in streamed(spark, tmp_path, parts, build) if r.k != -1]
    want, chains = [], {}
    for k, i, s, _, _ in rows:
        last, number = chains.get(k, (s, 0))
        closes = s - last >= 86400
        want.append((s, k, i, number, closes))
        chains[k] = (s, number + 1) if closes else (last, number)
    assert sorted([(r.s, r.k, r.id, r.buffer_id, r.closes) for r in have], key=lambda r: r[0]) == want


class Held:
    """A value or list of a state store, and its handle and clock."""

    def __init__(self):
        self.rows, self.timers, self.now = [], [], 0

    exists = lambda self: bool(self.rows)
    update = lambda self, row: setattr(self, "rows", [row])
    clear = lambda self: setattr(self, "rows", [])
    appendValue = lambda self, row: self.rows.append(row)
    registerTimer = lambda self, at: self.timers.append(at)
    getCurrentProcessingTimeInMs = getCurrentWatermarkInMs = lambda self: self.now
    getValueState = getListState = lambda self, *_: Held()


class Value(Held):
    get = lambda self: self.rows[0]


class Listed(Held):
    get = lambda self: iter(self.rows)


def test_a_silent_key_is_forgotten_alone():
    handle = Held()
    handle.getValueState, handle.getListState = lambda *_: Value(), lambda *_: Listed()
    buffers = stateful.GreedyBuffers(10_000_000, ["id", "key", "us"], ["id"], "key", "us", ["id"], [], 60_000)
    buffers.init(handle)

    def given(now, *rows):
        part = pd.DataFrame([(i, k, s * 1_000_000) for i, (k, s) in enumerate(rows)], columns=["x", "y", "z"])
        assert list(buffers.handleInputRows(0, iter([part]), handle)) == []
        handle.now = now * 1000
        return [tuple(r) for out in buffers.handleExpiredTimer(0, handle, None) for r in out.itertuples(index=False)]

    assert given(30, ("a", 0), ("b", 0), ("a", 10), ("b", 10)) == [(0, 0, False), (2, 0, True), (1, 0, False), (3, 0, True)]
    assert given(40, ("a", 40), ("b", 200)) == [(0, 1, True)]
    assert 70_000 not in handle.timers[-1:] and handle.timers[-1] == 100_000  # b still waits
    assert given(99, ("a", 99)) == [(0, 2, True)]
    assert given(200, ("c", 300)) == [(1, 1, True)]  # b was waiting, a is silent
    assert [k for k, *_ in stateful._unpacked(buffers.chains.get()[0]).itertuples(index=False)] == ["b"]


def test_a_key_expires_alone():
    handle = Held()
    handle.getValueState = lambda *_: Value()
    sequences = stateful.SequenceState(["k", "v", "ok"], ["v"], "k", "v", "ok", [], [], 0.1, 1000)
    sequences.init(handle)

    def given(now, *keys):
        handle.now = now
        part = pd.DataFrame([(k, 1.0, True) for k in keys], columns=["k", "v", "ok"])
        return [s for out in sequences.handleInputRows(0, iter([part]), handle) for s in out["seq"]]

    assert given(0, "a", "b", "a") == [1, 2, 1]
    assert given(600, "a") == [3]
    assert given(1200, "a", "b") == [4, 1]
