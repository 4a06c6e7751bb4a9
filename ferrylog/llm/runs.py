"""Periodic runs of words by a dictionary of basic factors.

A *run* is a stretch of consecutive words with smallest period q, at least ``LEAST_PERIODS`` periods and ``LEAST_WORDS`` words
long, that no neighbouring word extends keeping the period. Factors of 1, 2, 4, ... words get names, equal factors of one text
equal names; a name of twice the length is the pair of the names of its halves, and places whose factor occurs once
are left out of all longer ones. Inside a run of period q, the factor at its start of the shortest length L >= q next occurs q words
on, and again q words on: three occurrences at equal distances within twice their length propose a period. Each proposal
(the first of a stretch of places that propose alike) is extended to both sides word by word and kept if it is long enough;
the same run proposed by several lengths counts once. A proposed distance is the smallest period of its stretch, as a
smaller one would bring the next occurrence nearer.

Texts stay where Spark put them: a task names the factors of one batch of texts at a time, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylog.llm.common import arrow_table, bounded_batches, small_pieces

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words compared at once when a proposal is extended, and proposals extended at once.
STRIDE, TOGETHER = 64, 4096

REPORT = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64())]
    + [(name, pa.int64()) for name in ("start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)
RUNS = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))), ("collapsed", pa.string())])
RUNS_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
REPORT_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def next_names(places: np.ndarray, names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """From factors of ``size`` words to those of ``2 * size``: the places where one is repeated, and its names there."""
    other = np.searchsorted(places, places + size)
    other[other == len(places)] = 0
    whole = places[other] == places + size
    pairs = names[whole] * (names.max(initial=0) + 1) + names[other[whole]]
    return repeated(places[whole], pairs)


def repeated(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (ascending) whose key occurs more than once, and the keys as small numbers."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    several = counts[names] > 1
    return places[several], names[several]


def proposals(places: np.ndarray, names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and distances of three occurrences of one factor at equal distances of at most ``2 * size``."""
    order = np.argsort(names, kind="stable")
    at, name = places[order], names[order]
    gap = np.where(name[1:] == name[:-1], at[1:] - at[:-1], 0)
    found = np.flatnonzero((gap[:-1] == gap[1:]) & (gap[:-1] > 0) & (gap[:-1] <= 2 * size))
    start, period = at[found], gap[found]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)
    return start[first], period[first]


def equal_ahead(codes: np.ndarray, here: np.ndarray, there: np.ndarray, step: int) -> np.ndarray:
    """How many codes are equal from both places on, walking by ``step`` (1 or -1); ``codes`` end where they differ."""
    length = np.zeros(len(here), np.int64)
    live = np.arange(len(here))
    reach = np.arange(STRIDE) * step
    while len(live):
        moved = length[live] * step
        a = np.clip((here[live] + moved)[:, None] + reach, 0, len(codes) - 1)
        b = np.clip((there[live] + moved)[:, None] + reach, 0, len(codes) - 1)
        same = (codes[a] == codes[b]) & (a != b)
        whole = same.all(axis=1)
        length[live] += np.where(whole, STRIDE, np.argmin(same, axis=1))
        live = live[whole]
    return length


def find_runs(codes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all runs, in order, for the words ``codes`` of several texts, one after the other.

    ``texts`` tells words of different texts apart; runs do not cross texts.
    """
    fenced = np.full(len(codes) + 2, -1, np.int64)  # the fences differ from all words and from each other
    fenced[-1] = -2
    fenced[1:-1] = texts.astype(np.int64) * (codes.max(initial=0) + 1) + codes
    places, names = repeated(np.arange(len(codes), dtype=np.int64), fenced[1:-1])
    size, found = 1, []
    while len(places):
        start, period = proposals(places, names, size)
        for cut in range(0, len(start), TOGETHER):
            s, q = start[cut : cut + TOGETHER] + 1, period[cut : cut + TOGETHER]
            after = equal_ahead(fenced, s, s + q, 1)
            before = equal_ahead(fenced, s - 1, s + q - 1, -1)
            kept = after + before + q >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
            found.append(np.stack([s - before - 1, s + after + q - 1, q], axis=1)[kept])
        places, names = next_names(places, names, size)
        size *= 2
    runs = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def with_planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One text in ten, chosen by the crc32 of its id, ends in a repeated stretch; this is how the query tests long periods."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turns = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * turns)[: n - a]


def _batches(docs: DataFrame, doc_id: str, text: str, planted: bool, schema: pa.Schema, types: str, columns) -> DataFrame:
    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_pieces(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            texts = [(t or b"").split() for t in batch.column("text").to_pylist()]  # cuts bytes at ASCII white space only
            if planted:
                texts = [with_planted_period(i, w) for i, w in zip(ids, texts)]
            numbers: dict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            bounds = np.cumsum([0, *map(len, texts)])
            codes = np.fromiter((numbers[w] for words in texts for w in words), np.int64, bounds[-1])
            owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
            start, end, period = find_runs(codes, owner)
            dropped = np.zeros(len(codes) + 1, np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, end, -1)
            stays = np.cumsum(dropped)[:-1] == 0
            cuts = np.searchsorted(start, bounds)
            rows = []
            for k, words in enumerate(texts):
                own = slice(cuts[k], cuts[k + 1])
                runs = list(zip((start[own] - bounds[k]).tolist(), (end[own] - start[own]).tolist(), period[own].tolist()))
                kept = words if not runs else [words[j] for j in np.flatnonzero(stays[bounds[k] : bounds[k + 1]])]
                rows.append((ids[k], runs, b" ".join(kept)))
            yield arrow_table(columns(rows), schema)

    return chosen.mapInArrow(run, types)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", planted: bool = False) -> DataFrame:
    """``doc_id, runs, collapsed`` per row: its runs (word number, length and period, by start, then period) and its text
    without the words that a run holds after its first period, joined by single spaces.

    Words are what ASCII white space parts, case and all. A null or empty text has no runs and an empty collapsed text; a null id
    stays null; equal rows stay equal rows; an empty table gives an empty table. Overlapping runs and runs inside runs are all
    told. Other columns, whatever their names, are not looked at. A very long text is one batch of its own.
    ``planted`` first makes the ends of some texts periodic (:func:`with_planted_period`).
    """
    return _batches(
        docs, doc_id, text, planted, RUNS, RUNS_SCHEMA,
        lambda rows: {"doc_id": [r[0] for r in rows], "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r[1]] for r in rows], "collapsed": [r[2].decode() for r in rows]},
    )


def run_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", planted: bool = False) -> DataFrame:
    """Per row the number of runs, the longest (ties: smallest start, then period; nulls without any), and digests of all runs and
    of the collapsed text; see :func:`periodic_runs`."""
    return _batches(docs, doc_id, text, planted, REPORT, REPORT_SCHEMA, _report)


def _report(rows: list[tuple]) -> dict[str, list]:
    best = [max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None)) for _, runs, _ in rows]
    told = ["".join(f"{s},{n},{q}\n" for s, n, q in runs) for _, runs, _ in rows]
    return {
        "doc_id": [r[0] for r in rows],
        "n_runs": [len(r[1]) for r in rows],
        "start": [b[0] for b in best],
        "length": [b[1] for b in best],
        "period": [b[2] for b in best],
        "exponent_milli": [None if b[1] is None else 1000 * b[1] // b[2] for b in best],
        "runs_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in told],
        "collapsed_sha256": [hashlib.sha256(r[2]).hexdigest() for r in rows],
    }
