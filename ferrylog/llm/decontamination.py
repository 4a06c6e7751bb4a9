"""Benchmark decontamination by Wu-Manber search for many strings at once.

Texts become lower-cased words parted by single spaces. The search strings are the windows of ``WORDS`` consecutive words of all
benchmark items (an item of fewer words is one string), each with a space before and after. Strings of about the same length
make a *tier*. A tier looks at the block that ends where the first ``least`` bytes of a string would end: a table says
how far the next place is at which that block could end a string's beginning, and the search moves on by so much.
Where the answer is zero, the hash of this block and of the string's first bytes selects the strings to compare directly.

The search is done for all texts of a batch in step: every ``CHUNK`` bytes have a cursor of their own.

Benchmark texts are cut into pieces whose windows make up those of the text, and pieces into shards of about
``SHARD_BYTES``; one shard after the other is read by the driver, made into tables and broadcast. So what is broadcast at once is bounded however large
the benchmark is; each further shard is one more pass over the documents, and only what it hits is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylog.llm.common import arrow_table, bounded_batches, mix, small_pieces
from ferrylog.operators.skew import lookup_join, skew_join
from ferrylog.session import materialise

WORDS = 10
SHARD_BYTES, PIECE_WORDS = 2 << 20, 4096
#: Bytes per cursor, most bytes of a block, bits of a shift table.
CHUNK, BLOCK, TABLE_BITS = 512, 8, (10, 23)
SPACE, END = 32, 0
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Letters A-Z in lower case; digits, letters and all bytes beyond ASCII stay; all else parts words.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else SPACE for c in range(256))


def words_only(texts: Iterable[bytes | None]) -> np.ndarray:
    """All texts as ``" word word ... word " END``, one after the other, and eight more bytes."""
    joined = b" " + b"".join((t or b"").translate(FOLDED) + b" \0 " for t in texts)
    given = np.frombuffer(joined, np.uint8)[:-1]
    space = given == SPACE
    kept = np.ones(len(given), bool)
    kept[1:] = ~(space[1:] & space[:-1])
    return np.concatenate([given[kept], np.zeros(8, np.uint8)])


class Tier:
    """Search tables for the strings ``starts`` and ``sizes`` in ``data``; ``numbers`` says which strings they are."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray):
        self.least = int(sizes.min())
        self.block = min(BLOCK, max(2, self.least // 3))
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        self.first = np.uint64((1 << 8 * min(8, self.least)) - 1)
        last = self.least - self.block
        bits = min(max(math.ceil(math.log2(4 * len(starts) * (last + 1))), TABLE_BITS[0]), TABLE_BITS[1])
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, min(last + 1, 255), np.uint8)  # moving on by less than one could loses nothing
        near = eight_bytes(data)
        for offset in range(last + 1):  # later places stand nearer to the end and overwrite
            self.shift[self.cell(near[starts + offset] & self.mask)] = min(last - offset, 255)
        mark = self.mark(near, starts)
        order = np.argsort(mark, kind="stable")
        self.marks, self.starts, self.sizes, self.numbers = mark[order], starts[order], sizes[order], numbers[order]

    def cell(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks * _MULTIPLIER) >> self.down

    def mark(self, near: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mix((near[at + (self.least - self.block)] & self.mask) * _MULTIPLIER + (near[at] & self.first))

    def candidates(self, near: np.ndarray) -> np.ndarray:
        """Places that the shift table does not rule out."""
        at = np.arange(0, len(near), CHUNK)
        end = np.minimum(at + CHUNK, len(near) - self.least + 1)
        at, end = at[at < end], end[at < end]
        found = [at[:0]]
        while len(at):
            step = self.shift[self.cell(near[at + (self.least - self.block)] & self.mask)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]
        return np.concatenate(found)

    def search(self, near: np.ndarray, data_near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of occurrences and the strings that occur there."""
        at = self.candidates(near)
        mark = self.mark(near, at)
        low = np.searchsorted(self.marks, mark, "left")
        many = np.searchsorted(self.marks, mark, "right") - low
        pick = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        at = np.repeat(at, many)
        offset = 0
        while len(pick) and offset < self.sizes[pick].max():
            left = np.clip(self.sizes[pick] - offset, 0, 8).astype(np.uint64)
            mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
            here = np.minimum(at + offset, len(near) - 1)
            there = np.minimum(self.starts[pick] + offset, len(data_near) - 1)
            same = (near[here] & mask) == (data_near[there] & mask)
            at, pick = at[same], pick[same]
            offset += 8
        return at, self.numbers[pick]


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; the last seven places have none."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data.data, strides=(1,))


class Matcher:
    """The strings of one shard: ``pieces`` of benchmark texts with the classes they come from."""

    def __init__(self, pieces: list[tuple[int, bytes]]):
        numbers: dict[bytes, int] = {}
        classes: list[set[int]] = []
        for number, piece in pieces:
            text = b" " + piece + b" "
            at = [i for i, c in enumerate(text) if c == SPACE]
            for i in range(max(1, len(at) - WORDS)):
                key = text[at[i] : at[min(i + WORDS, len(at) - 1)] + 1]
                place = numbers.setdefault(key, len(numbers))
                if place == len(classes):
                    classes.append(set())
                classes[place].add(number)
        self.data = np.frombuffer(b"".join(numbers) + bytes(8), np.uint8)
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        starts = np.cumsum(sizes) - sizes
        self.words = np.fromiter((s.count(b" ") - 1 for s in numbers), np.int64, len(numbers))
        self.class_bounds = np.cumsum([0, *map(len, classes)])
        self.classes = np.fromiter((c for own in classes for c in sorted(own)), np.int64, self.class_bounds[-1])
        kind = np.minimum(np.floor(np.log2(np.maximum(sizes, 1))).astype(int), 5)
        chosen = [np.flatnonzero(kind == k) for k in np.unique(kind)]
        self.tiers = [Tier(self.data, starts[own], sizes[own], own) for own in chosen]

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``text`` (as :func:`words_only` makes it) and the strings that occur there."""
        near, data = eight_bytes(text), eight_bytes(self.data)
        found = [tier.search(near, data) for tier in self.tiers]
        return np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]]), np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])

    def search(self, texts: list[bytes | None]) -> dict[str, list]:
        """Per text the number of words, the stretches of words that strings cover, and the classes of these strings."""
        text = words_only(texts)
        at, which = self.occurrences(text)
        spaces = np.flatnonzero(text == SPACE)
        ends = np.flatnonzero(text[:-8] == END)
        bounds = np.concatenate([[0], np.searchsorted(spaces, ends)])  # spaces of each text; a word follows each but the last
        word = np.searchsorted(spaces, at)
        cover = np.zeros(len(spaces) + 1, np.int64)
        np.add.at(cover, word, 1)
        np.add.at(cover, word + self.words[which], -1)
        hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        start, stop = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
        order = np.argsort(word, kind="stable")
        word, which = word[order], which[order]
        told, cut = np.searchsorted(word, bounds), np.searchsorted(start, bounds)
        out: dict[str, list] = {"n_words": (np.diff(bounds) - 1).tolist(), "spans": [], "classes": []}
        for k, first in enumerate(bounds[:-1]):
            own = slice(cut[k], cut[k + 1])
            out["spans"].append([{"start": int(a - first), "stop": int(b - first)} for a, b in zip(start[own], stop[own])])
            strings = np.unique(which[told[k] : told[k + 1]]).tolist()
            numbers = [self.classes[self.class_bounds[s] : self.class_bounds[s + 1]] for s in strings]
            out["classes"].append(np.unique(np.concatenate(numbers)) if numbers else [])
        return out


HITS = pa.schema(
    [("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64())]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("classes", pa.list_(pa.int64()))]
)
HITS_SCHEMA = "doc_id long, digest binary, n_words long, spans array<struct<start:long,stop:long>>, classes array<long>"


def _classes(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``class, words`` of the different texts with words, and ``class, item_id`` of the items that have one."""
    chosen = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").cast("binary").alias("text"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_pieces(batches, "text"):
            words = [b" ".join((t or b"").translate(FOLDED).split()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.binary())], names=["item_id", "words"])

    given = materialise(chosen.mapInArrow(folded, "item_id string, words binary").where(F.length("words") > 0), "items")
    classes = materialise(given.select("words").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    members = given.where("item_id IS NOT NULL").distinct().join(classes, "words").select("class", "item_id")
    return classes, materialise(members, "members")


def _shards(classes: DataFrame) -> tuple[DataFrame, int]:
    """``class, piece, shard`` and the number of shards."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column("class").to_pylist(), batch.column("words").to_pylist()):
                words = text.split(b" ")
                last = max(1, len(words) - WORDS + 1)
                pieces = [b" ".join(words[i : min(i + PIECE_WORDS, last) + WORDS - 1]) for i in range(0, last, PIECE_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], names=["class", "piece"])

    pieces = materialise(classes.select("class", "words").mapInArrow(cut, "class long, piece binary"), "pieces")
    total = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    return pieces.withColumn("shard", F.pmod(F.xxhash64("class", "piece"), F.lit(shards))), shards


def _scan(docs: DataFrame, matcher: Matcher, all_rows: bool) -> DataFrame:
    """One pass over ``doc_id, text``; ``all_rows``: documents without a hit too."""
    shipped = docs.sparkSession.sparkContext.broadcast(matcher)  # one shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in small_pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            columns = own.search(texts) | {"doc_id": batch.column("doc_id").to_pylist()}
            columns["digest"] = [hashlib.sha256(t or b"").digest() if all_rows or s else b"" for t, s in zip(texts, columns["spans"])]
            rows = arrow_table({f.name: columns[f.name] for f in HITS}, HITS)
            yield rows if all_rows else rows.filter(pa.array([bool(s) for s in columns["spans"]]))

    return docs.mapInArrow(run, HITS_SCHEMA)


def covered(spans: str) -> Column:
    """The number of words inside at least one of several stretches."""
    count, reach = (lambda s: s["count"]), (lambda s: s["reach"])
    step = lambda s, x: F.struct(
        (count(s) + F.greatest(x["stop"] - F.greatest(x["start"], reach(s)), F.lit(0).cast("long"))).alias("count"), F.greatest(reach(s), x["stop"]).alias("reach")
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("reach")), step, count)


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Per document ``doc_id, n_words, spans, n_hit, n_items, items_sha256, contaminated``.

    ``spans`` are the stretches of word numbers inside occurrences of benchmark windows (start inclusive, stop exclusive), ``n_hit`` their
    words, ``n_items`` and ``items_sha256`` (ids sorted as text, joined by commas) the items with occurring windows.

    A null text has no words, like an empty one; items without words occur nowhere; an item without an id marks words but is
    no item; an id that stands for several texts counts once. Null ids of documents stay null and equal rows equal rows. An empty
    table of documents gives an empty table, an empty benchmark clean documents. Other columns, whatever their names,
    are not looked at. A very long text is one batch of its own; a very long item is searched in pieces.
    """
    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    classes, members = _classes(items, item_id, item_text)
    pieces, shards = _shards(classes)
    passes = []
    for shard in range(shards):
        rows = pieces.where(F.col("shard") == shard).select("class", "piece").collect()  # about SHARD_BYTES
        passes.append(materialise(_scan(chosen, Matcher([(r["class"], bytes(r["piece"])) for r in rows]), shard == 0), "hits"))
    found = passes[0]
    if shards > 1:
        more = functools.reduce(DataFrame.union, [p.select("digest", "spans", "classes") for p in passes[1:]]).distinct()
        more = more.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("classes")).alias("_classes"))
        found = skew_join(found, more, ["digest"], ["doc_id", "digest"], "left")
        joined = lambda a, b: F.concat(F.col(a), F.coalesce(F.col(b), F.array()))
        found = materialise(found.select("doc_id", "n_words", joined("spans", "_spans").alias("spans"), F.array_sort(F.array_distinct(joined("classes", "_classes"))).alias("classes")), "hits")
    named = found.withColumn("_set", F.when(F.size("classes") > 0, F.sha2(F.array_join("classes", ","), 256)))
    sets = named.where("_set IS NOT NULL").select("_set", "classes").distinct()  # copies of a passage share one set
    listed = sets.select("_set", F.explode("classes").alias("class")).join(members, "class").groupBy("_set").agg(F.collect_set("item_id").alias("ids"))
    told = listed.select("_set", F.size("ids").cast("long").alias("_n"), F.sha2(F.array_join(F.sort_array("ids"), ","), 256).alias("_sha"))
    rows = lookup_join(named.drop("digest", "classes"), materialise(told, "sets"), ["_set"], ["doc_id", "n_words"], "left")
    return rows.select(
        "doc_id",
        "n_words",
        "spans",
        covered("spans").alias("n_hit"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("_sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
