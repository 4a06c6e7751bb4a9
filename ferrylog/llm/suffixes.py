"""Passages that repeat across documents, by sparse suffix arrays.

Only suffixes that start at content-selected places are kept: of every ``LEAST`` consecutive words, the ``GRAM`` words of smallest hash
(a minimiser). A passage of ``LEAST`` or more words that two documents share has the same words chosen in both, so at least one kept
suffix of each starts alike. Suffixes are sorted by their first ``GRAM`` words and neighbours compared; only where
neighbours of different documents start alike is the text read again, and the match extended left and right: each
window of ``LEAST`` words that chose the suffix is compared with the windows of its neighbours, and overlapping repeated windows
join to maximal spans. So a span is found exactly if every ``LEAST`` consecutive words of it occur in another document.

Documents of the same words are one class from the start. Lists of a suffix that very many documents share are not compared in
one place but through partial aggregates of their windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrylog.llm.common import MULTIPLIER, WordHashes, arrow_table, bounded_batches, mix, small_pieces
from ferrylog.session import materialise

#: Repeated passages have so many words or more; suffixes are sorted by so many.
LEAST, GRAM = 50, 16
#: Lists with more suffixes are compared through aggregates. A list of this length takes about 20 MB in the task that compares it.
BLOCK = 1 << 15
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def _words(text: str, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words; A-Z and a-z are the same, words are parted by ASCII blanks."""
    return hashes.of(text.encode().lower().split())


def _powers(base: np.uint64, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


def run_hashes(words: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length the hash of every run of so many words, whatever its place: differences of one running sum."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_INVERSE, len(words)), dtype=np.uint64)])
    lift = _powers(MULTIPLIER, len(words) + 1)
    return [mix((sums[n:] - sums[: len(sums) - n]) * lift[: len(sums) - n] + np.uint64(n)) for n in lengths]


def chosen_places(grams: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The places of the minimisers, and the first window that chose each (one more entry says how many windows there are)."""
    span = least - gram + 1
    if len(grams) < span:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    parts, step = [], 1 << 16
    for a in range(0, len(grams) - span + 1, step):
        view = np.lib.stride_tricks.sliding_window_view(grams[a : a + step + span - 1], span)
        parts.append(view.argmin(axis=1) + np.arange(a, a + len(view)))
    picked = np.concatenate(parts)
    first = np.flatnonzero(np.append(True, picked[1:] != picked[:-1]))
    return picked[first], np.append(first, len(picked))


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("words_id", pa.binary()), ("places", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, text: str) -> DataFrame:
    """Per row ``doc_id``, the number and a digest of its words, and its minimisers: their places and hashes."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_pieces(batches, "_text"):
            rows: dict[str, list] = {"n_words": [], "words_id": [], "places": [], "keys": []}
            for t in batch.column("_text").to_pylist():
                words = _words(t, hashes)
                grams = run_hashes(words, GRAM)[0] if len(words) >= LEAST else words[:0]
                places, _ = chosen_places(grams)
                rows["n_words"].append(len(words))
                rows["words_id"].append(xxhash.xxh3_128_digest(words.tobytes()))
                rows["places"].append(places.astype(np.int32))
                rows["keys"].append(grams[places].view(np.int64))
            yield arrow_table({"doc_id": batch.column("doc_id")} | rows, SKETCH)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, words_id binary, places array<int>, keys array<long>")


WINDOWS = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("words_id", pa.binary()), ("first", pa.int32()), ("windows", pa.list_(pa.int64()))])


def _extended(docs: DataFrame, shared: DataFrame, text: str) -> DataFrame:
    """``key, rep, words_id, first, windows``: for each shared suffix the hashes of the windows that chose it, the first at ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_pieces(batches, "_text"):
            rows: dict[str, list] = {f.name: [] for f in WINDOWS}
            for t, rep, own, wanted in zip(*(batch.column(c).to_pylist() for c in ("_text", "rep", "words_id", "wanted")), strict=True):
                words = _words(t, hashes)
                if xxhash.xxh3_128_digest(words.tobytes()) != own:
                    continue  # another text of the same id
                grams, windows = run_hashes(words, GRAM, LEAST)
                places, firsts = chosen_places(grams)
                for n in np.flatnonzero(np.isin(places, wanted)):
                    rows["key"].append(grams[places[n]].view(np.int64))
                    rows["rep"].append(rep)
                    rows["words_id"].append(own)
                    rows["first"].append(firsts[n])
                    rows["windows"].append(windows[firsts[n] : firsts[n + 1]].view(np.int64))
            yield arrow_table(rows, WINDOWS)

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    places = shared.groupBy("rep", "words_id").agg(F.collect_list("place").alias("wanted"))  # no more than a text has words
    found = texts.join(materialise(places, "places"), "rep").withColumn("_same", F.xxhash64("_text")).dropDuplicates(["rep", "words_id", "_same"])
    return found.select("_text", "rep", "words_id", "wanted").mapInArrow(run, "key long, rep long, words_id binary, first int, windows array<long>")


SPANS = pa.schema([("words_id", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()), ("first_id", pa.int64())])


def _compared(rows: DataFrame) -> DataFrame:
    """``words_id, start, stop, first_id``: runs of repeated windows of lists of bounded length, list by list."""

    def compare(reps: np.ndarray, owners: list[bytes], firsts: np.ndarray, windows: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        whole = np.concatenate(windows)
        row = np.repeat(np.arange(len(windows)), sizes)
        place = firsts[row] + np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(whole, kind="stable")
        ordered, rep = whole[order], reps[row[order]]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        low, high = np.minimum.reduceat(rep, starts), np.maximum.reduceat(rep, starts)
        group = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        repeated, least = np.zeros(len(whole), bool), np.zeros(len(whole), np.int64)
        repeated[order], least[order] = (low != high)[group], low[group]
        begins = np.flatnonzero(repeated & ~(np.append(False, repeated[:-1]) & np.append(False, row[1:] == row[:-1])))
        ends = np.flatnonzero(repeated & ~(np.append(repeated[1:], False) & np.append(row[1:] == row[:-1], False)))
        firsts_of = np.minimum.reduceat(np.where(repeated, least, np.iinfo(np.int64).max), begins) if len(begins) else least[:0]
        return arrow_table(
            {"words_id": [owners[i] for i in row[begins]], "start": place[begins].astype(np.int32), "stop": (place[ends] + LEAST).astype(np.int32), "first_id": firsts_of}, SPANS
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = [np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0, np.int64), []]
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("windows")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
            new = [
                batch.column("key").to_numpy(), batch.column("rep").to_numpy(), batch.column("words_id").to_pylist(),
                batch.column("first").to_numpy().astype(np.int64), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)],
            ]
            kept = [np.concatenate([a, b]) if isinstance(a, np.ndarray) else a + b for a, b in zip(kept, new, strict=True)]
            cut = int(np.searchsorted(kept[0], kept[0][-1]))  # the last list may go on in the next batch
            if cut:
                yield compare(*[x[:cut] for x in kept[1:]])
            kept = [x[cut:] for x in kept]
        if len(kept[0]):
            yield compare(*kept[1:])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = rows.select("key", "rep", "words_id", "first", "windows").repartition(parts, "key").sortWithinPartitions("key")
    return listed.mapInArrow(run, "words_id binary, start int, stop int, first_id long")


def _aggregated(rows: DataFrame) -> DataFrame:
    """The same for lists of any length: windows are counted by partial aggregates and looked up by a join that can be split."""
    each = rows.select("words_id", "rep", "first", F.posexplode("windows").alias("i", "window"))
    repeated = each.groupBy("window").agg(F.min("rep").alias("first_id"), F.max("rep").alias("last")).where("first_id != last").drop("last")
    found = each.join(materialise(repeated, "windows"), "window")
    start = (F.col("first") + F.col("i")).cast("int")
    return found.select("words_id", start.alias("start"), (start + LEAST).cast("int").alias("stop"), "first_id")


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a class as one."""
    by_place = Window.partitionBy("words_id").orderBy("start", "stop")
    reached = F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1))
    numbered = marked.withColumn("number", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("words_id", "number").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_id").alias("first_id")).drop("number")


def repeated_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, start_word, end_word, n_words, first_id, kept``: maximal spans whose every ``LEAST`` words occur in another document.

    Words are counted from 0, the end exclusive. ``first_id`` is the smallest id of a document that holds some of the span's windows, ``kept``
    says that it is the row's own, so that dropping the others leaves one copy. Repeats within one id do not count. Null, empty and short
    texts have no spans; rows that repeat an id and its words have a row each; rows without an id take no part; an empty
    table gives none. Other columns are not looked at.
    """
    drawn = materialise(sketches(docs.where("doc_id IS NOT NULL"), text).where(F.col("n_words") >= LEAST), "sketches")
    classes = drawn.groupBy("words_id").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n_words").alias("n_words"), F.first("places").alias("places"), F.first("keys").alias("keys")
    )
    classes = materialise(classes, "classes")
    suffixes = classes.select("rep", "words_id", F.inline(F.arrays_zip("places", "keys"))).toDF("rep", "words_id", "place", "key")
    # sorted neighbours that start alike: per start, whether different documents have it, and how many suffixes there are
    alike = suffixes.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("size")).where("low != high")
    alike = materialise(alike.select("key", "size"), "alike")
    shared = suffixes.join(alike, "key").select("rep", "words_id", "place")
    windows = materialise(_extended(docs, shared, text).join(alike, "key"), "windows")
    copied = classes.where("rep != last").select("words_id", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop"), F.col("rep").alias("first_id"))
    found = _compared(windows.where(F.col("size") <= BLOCK)).unionByName(_aggregated(windows.where(F.col("size") > BLOCK))).unionByName(copied)
    spans = materialise(_joined(found), "spans")
    told = drawn.select("doc_id", "words_id").join(spans, "words_id")
    return told.select(
        "doc_id", F.col("start").alias("start_word"), F.col("stop").alias("end_word"), (F.col("stop") - F.col("start")).alias("n_words"), "first_id", (F.col("doc_id") == F.col("first_id")).alias("kept")
    )
