"""Per-key state in streams: change detection, running values, moving averages, service status, greedy time buffers.

The state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``). Rows of a key
are taken in order of the given columns within each micro-batch; batches arrive in order.

A call of a stateful function costs milliseconds, however few rows it gets, so keys are dealt to a fixed number of buckets by a hash, and a bucket's
rows of one micro-batch are handled in one call. State lies per bucket, as a table with a row per key. The number of buckets must stay what it was for
a checkpoint; a bucket's rows of one micro-batch and its keys must fit into a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ferrylog.functions.schemas import BOOL, DOUBLE, LONG, TEXT, struct
from ferrylog.operators.buffers import mark_closes
from ferrylog.operators.health import UNHEALTHY_AFTER

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PIECE = 10_000  # rows handed on at a time
BUCKETS = 256
ADDED = struct(seq=LONG, changed=BOOL, total=DOUBLE, ema=DOUBLE, consecutive_failures=LONG, status=TEXT)
PACKED = struct(rows=T.BinaryType())


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(value)).read_pandas()


def _text(stream: DataFrame, key: str) -> Column:
    """A key column as text, equal for values that a grouping takes as equal."""
    kind = stream.schema[key].dataType
    if isinstance(kind, T.BinaryType):
        return F.hex(key)
    return (F.col(key) + F.lit(0.0) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(key)).cast("string")


@dataclass(frozen=True)
class Dealt:
    """A stream's rows on their way through buckets: the own columns, some more, and whether a long is null.

    Pandas holds a column of longs with nulls as doubles, which are not exact, so a long travels as 0 beside a mark and is put back after.
    """

    rows: DataFrame
    own: list[T.StructField]
    names: list[str]
    key: str
    bucket: str
    marks: dict[str, str]

    @staticmethod
    def of(stream: DataFrame, keys: Sequence[str], buckets: int, more: dict[str, Column]) -> Dealt:
        """``more`` columns are named anew, in ``names`` they follow the own ones."""
        own, prefix = list(stream.schema.fields), "_"
        while any(f.name.startswith(prefix) for f in own):
            prefix += "_"
        marks = {f.name: f"{prefix}null{i}" for i, f in enumerate(own) if isinstance(f.dataType, T.LongType) and f.nullable}
        added = {f"{prefix}{n}": c for n, c in more.items()}
        added |= {m: F.col(n).isNull() for n, m in marks.items()}
        added[f"{prefix}key"] = F.to_json(F.array(*[_text(stream, k) for k in keys]).cast("array<string>"))
        added[f"{prefix}bucket"] = (F.pmod(F.xxhash64(*keys), F.lit(buckets)) if keys else F.lit(0)).cast("int")
        rows = stream.withColumns(added).withColumns({n: F.coalesce(F.col(n), F.lit(0).cast("long")) for n in marks})
        names = [*[f.name for f in own], *added]
        return Dealt(rows, own, names, f"{prefix}key", f"{prefix}bucket", marks)

    def more(self) -> list[str]:
        return self.names[len(self.own) :]

    def order(self, columns: Sequence[str]) -> list[str]:
        """What to sort by in place of some columns, nulls last."""
        return [n for c in columns for n in ([self.marks[c], c] if c in self.marks else [c])]

    def handled(self, processor: StatefulProcessor, added: T.StructType, time_mode: str) -> DataFrame:
        """What a processor makes of the buckets' rows: the own columns and the added ones."""
        marked = [T.StructField(m, T.BooleanType()) for m in self.marks.values()]
        out = self.rows.groupBy(self.bucket).transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType=T.StructType([*self.own, *added.fields, *marked]),
            outputMode="Append",
            timeMode=time_mode,
        )
        own = [F.when(~F.col(self.marks[f.name]), F.col(f.name)).alias(f.name) if f.name in self.marks else F.col(f.name) for f in self.own]
        return out.select(*own, *added.fieldNames())


def _by_key(rows: pd.DataFrame, key: str, order: Sequence[str]) -> tuple[pd.DataFrame, list[tuple[str, int, int]]]:
    """Rows sorted by key and order, and where each key's rows begin and end."""
    codes, texts = pd.factorize(rows[key])
    place = "_place"
    while place in rows.columns:
        place += "_"
    rows = rows.assign(**{place: codes}).sort_values([place, *order], kind="stable", ignore_index=True)
    ends = np.cumsum(np.bincount(codes, minlength=len(texts)))
    return rows.drop(columns=place), list(zip(texts, [0, *ends[:-1].tolist()], ends.tolist()))


class SequenceState(StatefulProcessor):
    """Adds seq, changed, total, ema, consecutive_failures and status to every row of a bucket's keys.

    State is a row per key. With ``ttl_ms`` a key that got no rows for that long begins anew.
    """

    NEW = (0, None, 0.0, None, 0, "unknown")
    COLUMNS = ("key", "seq", "last", "total", "ema", "failures", "status", "seen")

    def __init__(self, names: Sequence[str], kept: Sequence[str], key: str, value: str, ok: str, order: Sequence[str], marks: Sequence[str], alpha: float, ttl_ms: int | None) -> None:
        self.names, self.kept, self.key, self.value, self.ok = list(names), list(kept), key, value, ok
        self.order, self.marks, self.alpha, self.ttl_ms = list(order), list(marks), alpha, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sequences", PACKED, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        held = _unpacked(self.state.get()[0]) if self.state.exists() else pd.DataFrame(columns=self.COLUMNS)
        if self.ttl_ms:
            held = held[held["seen"] + self.ttl_ms > now]
        states = {k: s for k, *s in held.itertuples(index=False, name=None)}
        # streams know no sort, so a bucket's rows of one micro-batch meet here; how many that can be is set at the source
        batch, places = _by_key(pd.concat(list(rows), ignore_index=True).set_axis(self.names, axis=1), self.key, self.order)
        if not places:
            return
        values, ok, parts = batch[self.value].to_numpy(float), batch[self.ok].to_numpy(bool), []
        for text, a, b in places:
            state, added = self._advance(tuple(states.get(text, self.NEW)[:6]), values[a:b], ok[a:b])
            states[text] = [*state, now]
            parts.append(added)
        self.state.update((_packed(pd.DataFrame([(k, *s) for k, s in states.items()], columns=self.COLUMNS)),))
        added = {n: np.concatenate(c) for n, c in zip(ADDED.fieldNames(), zip(*parts))}
        out = pd.concat([batch[self.kept], pd.DataFrame(added), batch[self.marks]], axis=1)
        for a in range(0, len(out), PIECE):
            yield out.iloc[a : a + PIECE].reset_index(drop=True)

    def _advance(self, state: tuple, values: np.ndarray, ok: np.ndarray) -> tuple[tuple, tuple[np.ndarray, ...]]:
        """The running columns of some more rows of a key, and its state after them."""
        seq, last, total, ema, failures, status = state
        places = np.arange(len(values))
        before = np.concatenate([[np.nan if last is None else last], values[:-1]])
        changed = values != before
        changed[0] |= seq == 0
        averages = self._averages(values, ema)
        last_ok = np.maximum.accumulate(np.where(ok, places, -1))
        runs = np.where(last_ok >= 0, places - last_ok, places + 1 + failures)
        decided = np.where(ok, 1, np.where(runs >= UNHEALTHY_AFTER, 2, 0))
        since = np.maximum.accumulate(np.where(decided > 0, places, -1))
        names = np.array([status, "healthy", "unhealthy"], dtype=object)
        statuses = names[np.where(since >= 0, decided[np.maximum(since, 0)], 0)]
        totals = np.cumsum(np.concatenate([[total], values]))[1:]
        added = (seq + 1 + places, changed, totals, averages, runs, statuses)
        return (seq + len(values), float(values[-1]), float(totals[-1]), float(averages[-1]), int(runs[-1]), str(statuses[-1])), added

    def _averages(self, values: np.ndarray, ema: float | None) -> np.ndarray:
        """Moving averages, in blocks so short that powers of 1 - alpha stay within double precision."""
        q = 1.0 - self.alpha
        size = len(values) if q in (0.0, 1.0) else max(1, int(math.log(1e-100) / math.log(q)))
        out = np.empty(len(values))
        for a in range(0, len(values), size):
            x = values[a : a + size] * self.alpha
            if ema is None:
                x[0], ema = values[a], 0.0
                carried = 0.0
            else:
                carried = ema
            powers = q ** np.arange(len(x) + 1)
            own = np.cumsum(x / powers[:-1]) * powers[:-1] if q else x
            out[a : a + size] = own + carried * powers[1:]
            ema = out[min(a + size, len(values)) - 1]
        return out

    def close(self) -> None:
        pass


def with_sequence_state(
    stream: DataFrame,
    key: str,
    value: str,
    ok: str,
    order: Sequence[str],
    alpha: float = 0.1,
    ttl_ms: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The running columns of :class:`SequenceState` per key, kept between micro-batches."""
    more = {"value": F.col(value).cast("double"), "ok": F.coalesce(F.col(ok).cast("boolean"), F.lit(False))}
    dealt = Dealt.of(stream, [key], buckets, more)
    given = dealt.more()[: len(more)]
    own = [f.name for f in dealt.own]
    processor = SequenceState(dealt.names, own, dealt.key, *given, dealt.order(order), list(dealt.marks.values()), alpha, ttl_ms)
    return dealt.handled(processor, ADDED, "ProcessingTime" if ttl_ms else "None")


DUE = struct(at=LONG)
BUFFERED = struct(buffer_id=LONG, closes=BOOL)


class GreedyBuffers(StatefulProcessor):
    """Deals rows of a bucket's keys to greedy time buffers once the watermark has passed them.

    Rows wait until no earlier one can come any more; a timer at the first waiting row's time then takes all that are due, each key's in order of time,
    continues the key's chain of closes with them and hands them on. State is the chains (three numbers per key) and the rows the watermark has not
    passed. With ``forget_ms`` a key silent for that long in event time is forgotten and begins anew.
    """

    COLUMNS = ("key", "last", "number", "seen")

    def __init__(self, span: int, names: Sequence[str], kept: Sequence[str], key: str, time: str, order: Sequence[str], marks: Sequence[str], forget_ms: int | None) -> None:
        self.span, self.names, self.kept, self.key, self.time = span, list(names), list(kept), key, time
        self.order, self.marks, self.forget_ms = list(order), list(marks), forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chains = handle.getValueState("chains", PACKED)
        self.waiting = handle.getListState("waiting", PACKED)
        self.due = handle.getValueState("due", DUE)

    def _wake(self, us: int) -> None:
        """A timer for rows of this time, unless an earlier one is set."""
        at = -(-us // 1000)
        if not self.due.exists() or at < self.due.get()[0]:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                part = part.set_axis(self.names, axis=1)  # Spark renames columns that are no Python names
                self.waiting.appendValue((_packed(part),))
                begun = int(part[self.time].min())
                first = begun if first is None else min(first, begun)
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [_unpacked(row[0]) for row in self.waiting.get()] if self.waiting.exists() else []
        self.due.clear()
        busy, ready, later = set(), None, set()
        if held:
            rows = pd.concat(held, ignore_index=True)
            due = (rows[self.time] <= passed * 1000).to_numpy()
            busy, ready = set(rows[self.key]), rows[due]
            self.waiting.clear()
            if not due.all():
                rest = rows[~due].reset_index(drop=True)
                later = set(rest[self.key])
                self.waiting.appendValue((_packed(rest),))
                self._wake(int(rest[self.time].min()))
        if self.forget_ms is None and (ready is None or not len(ready)):
            return
        chains = {}
        if self.chains.exists():
            chains = {k: tuple(c) for k, *c in _unpacked(self.chains.get()[0]).itertuples(index=False, name=None)}
        if self.forget_ms is not None:
            chains = {k: c for k, c in chains.items() if k in busy or c[2] // 1000 + self.forget_ms > passed}
        if ready is not None and len(ready):
            yield from self._dealt(ready, chains)
        self.chains.update((_packed(pd.DataFrame([(k, *c) for k, c in chains.items()], columns=self.COLUMNS)),))
        silent = [c[2] for k, c in chains.items() if k not in later]
        if self.forget_ms is not None and silent:
            self.handle.registerTimer(min(silent) // 1000 + self.forget_ms)

    def _dealt(self, rows: pd.DataFrame, chains: dict[str, tuple[int, int, int]]) -> Iterator[pd.DataFrame]:
        """The rows with their buffers; ``chains`` go on with them."""
        rows, places = _by_key(rows, self.key, [self.time, *self.order])
        times = rows[self.time].to_numpy(np.int64)
        closes, number = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        for text, a, b in places:
            last, count, _ = chains.get(text, (int(times[a]), 0, 0))
            last, count = mark_closes(times[a:b], int(last), self.span, closes[a:b], number[a:b], int(count))
            chains[text] = (last, count, int(times[b - 1]))
        added = pd.concat([rows[self.kept].assign(buffer_id=number, closes=closes), rows[self.marks]], axis=1)
        for a in range(0, len(added), PIECE):
            yield added.iloc[a : a + PIECE]

    def close(self) -> None:
        pass


def buffer_greedy_stream(
    stream: DataFrame,
    ts: str,
    span_seconds: float,
    watermark: str,
    order: Sequence[str],
    keys: Sequence[str],
    forget_seconds: float | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """:func:`ferrylog.operators.buffers.buffer_greedy` on a stream: rows with ``buffer_id`` and ``closes``, exact for every row within the watermark.

    A row comes out once the watermark has passed it, since an earlier one might change its buffer; later rows are dropped and counted by Spark. A null time is never
    passed, so such rows are left out. Each key is a chain of its own and goes through one task with the keys of its bucket; beside three numbers per key, state
    is bounded by what arrives within the watermark's delay.
    """
    span = round(span_seconds * 1_000_000)
    if span < 1:
        raise ValueError("a buffer spans at least a microsecond")
    forget = None if forget_seconds is None else round(forget_seconds * 1000)
    timed = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, watermark)
    dealt = Dealt.of(timed, keys, buckets, {"micros": F.unix_micros(ts)})
    time, own = dealt.more()[0], [f.name for f in dealt.own]
    processor = GreedyBuffers(span, dealt.names, own, dealt.key, time, dealt.order(order), list(dealt.marks.values()), forget)
    return dealt.handled(processor, BUFFERED, "EventTime")
