"""Near-duplicate texts by a multi-index Hamming join of b-bit MinHash signatures.

A text's set are its distinct shingles of ``SHINGLE`` words. Its signature has ``SYMBOLS`` MinHash values of 16 bits; two
sets of Jaccard similarity J differ in about (1 - J) of them. Signatures are cut into ``CHUNKS`` chunks. Two signatures
that differ in at most ``DISTANCE`` = 2 * CHUNKS - 1 symbols have, by the pigeonhole principle, a chunk with at most one
differing symbol. So each chunk is filed once per symbol left out, and every pair within the distance meets in
a bucket. At J = 0.85 a pair lies beyond the distance with a chance of about one in a hundred thousand.

Pairs that meet are links only after a comparison of their full sets. Exact copies are one class before anything is
filed. What is wanted are components, so a bucket need not confirm all its pairs:

1. In each bucket one member is the centre; of its candidate centres each class tries the nearest. The smallest member is
   the centre first, then, in buckets that still hold several components, members chosen by a hash.
2. Where a bucket then still has members of several components, all pairs between different components whose signatures are
   within the distance become candidates. Hot buckets are cut into blocks, and blocks meet pairwise.
3. Components try their nearest candidates first, then more of them, then all that are left and still lie between
   different components. So each pair that meets is confirmed, refuted, or inside one component.

Beside the signature a class has an odd sketch: for each of ``BITS`` places, whether an odd number of its shingles fall there.
Two sets differ in at least as many shingles as their sketches differ in places. A pair for which that is already too many
is refuted for certain, without its full sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrylog.llm.common import MULTIPLIER, WordHashes, arrow_table, bounded_batches, free_name, mix, small_pieces
from ferrylog.llm.graph import components, follow
from ferrylog.operators.skew import lookup_join
from ferrylog.session import materialise, new_path

SHINGLE = 5
SYMBOLS, CHUNKS = 64, 12
DISTANCE = 2 * CHUNKS - 1
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Buckets with more members are cut into blocks of about so many.
BLOCK = 1024
#: Rounds with one centre per bucket, and candidates that a component tries in the rounds after these but the last.
STARS, TRIES = 3, (1, 16)
BITS = 1024
_RNG = np.random.default_rng(20240501)
_FACTORS = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_EDGES = [round(i * SYMBOLS / CHUNKS) for i in range(CHUNKS + 1)]
_CHUNK_OF = np.repeat(np.arange(CHUNKS), np.diff(_EDGES))


def shingle_set(text: str, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; bytes.lower and bytes.split know A-Z and ASCII blanks only."""
    words = hashes.of(text.encode().lower().split())
    width = min(size, len(words))
    if not width:
        return words
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        rolled = rolled * MULTIPLIER + words[j : len(words) - width + 1 + j]
    return np.unique(mix(rolled))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit symbols per set; sets must not be empty."""
    if not sets:
        return np.zeros((0, SYMBOLS), np.uint16)
    whole = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    firsts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((whole ^ _MASKS[k]) * _FACTORS[k], firsts)
        out[:, k] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BITS`` bits (in bytes) per set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places = (np.concatenate(sets) % np.uint64(BITS)).astype(np.int64) if sets else owner
    odd = np.bincount(owner * BITS + places, minlength=len(sets) * BITS).reshape(len(sets), BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def possible(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets with such sketches (rows of 64-bit words) and such a sum of sizes can be similar enough."""
    differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return differ * (100 + PERCENT) <= sizes * (100 - PERCENT)


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


SKETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("signature", pa.binary()), ("odd", pa.binary())])


def text_key(text: str) -> Column:
    """Tells apart texts of one id, null read as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row ``doc_id``, the size of its set, and a 128-bit digest, the signature and the odd sketch of the set (null if empty)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_pieces(batches, "_text"):
            sets = [shingle_set(t, hashes) for t in batch.column("_text").to_pylist()]
            some = [s for s in sets if len(s)]
            full, odd = iter(signatures(some)), iter(odd_sketches(some))
            columns = {
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                "n_shingles": [len(s) for s in sets],
                "set_id": [set_digest(s) if len(s) else None for s in sets],
                "signature": [next(full).tobytes() if len(s) else None for s in sets],
                "odd": [next(odd).tobytes() if len(s) else None for s in sets],
            }
            yield arrow_table(columns, SKETCH)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return chosen.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_id binary, signature binary, odd binary")


def postings(classes: DataFrame) -> DataFrame:
    """``key, slot, rep``: the buckets of each class; slot s is the chunk of symbol s without that symbol."""
    filed = []
    for slot in range(SYMBOLS):
        first, last = _EDGES[_CHUNK_OF[slot]], _EDGES[_CHUNK_OF[slot] + 1]
        before = F.substring("signature", 2 * first + 1, 2 * (slot - first))
        after = F.substring("signature", 2 * slot + 3, 2 * (last - slot - 1))
        filed.append(F.xxhash64(F.lit(slot), before, after))
    return classes.select("rep", F.posexplode(F.array(*filed)).alias("slot", "key"))


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b, distance`` of the pairs ``a, b`` that set sizes, signatures and odd sketches allow."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("rep").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "signature", "odd")]), side)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])

    def rows(column, kind) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = (rows(batch.column("signature_a"), np.uint16) != rows(batch.column("signature_b"), np.uint16)).sum(axis=1)
            ok = (distance <= DISTANCE) & possible(rows(batch.column("odd_a"), np.uint64), rows(batch.column("odd_b"), np.uint64), batch.column("sizes").to_numpy())
            yield batch.select(["a", "b"]).append_column("distance", pa.array(distance, pa.int32())).filter(pa.array(ok)).cast(schema)

    fits = pairs.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return fits.select("a", "b", "signature_a", "signature_b", "odd_a", "odd_b", (F.col("n_a") + F.col("n_b")).alias("sizes")).mapInArrow(run, "a long, b long, distance int")


class ShingleSets:
    """The full sets of the classes that share a bucket, in a table bucketed by class so that joins need not move it."""

    def __init__(self, docs: DataFrame, wanted: DataFrame, text: str):
        self.spark = docs.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"shingle_sets_{uuid.uuid4().hex}", new_path(self.spark, "sets")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])
            for batch in small_pieces(batches, "_text"):
                sets = [shingle_set(t, hashes) for t in batch.column("_text").to_pylist()]
                own = [set_digest(s) == i for s, i in zip(sets, batch.column("set_id").to_pylist(), strict=True)]
                yield arrow_table({"rep": batch.column("rep"), "shingles": [s.tobytes() for s in sets]}, schema).filter(pa.array(own))

        texts = docs.select(F.col("doc_id").cast("long").alias("low"), text_key(text).alias("low_text"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
        # one text of each class, which its smallest id and a hash name; rows that repeat both are one
        own = texts.join(wanted, ["low", "low_text"]).dropDuplicates(["rep"]).select("rep", "set_id", "_text")
        sets = own.mapInArrow(run, "rep long, shingles binary").repartition(self.parts, "rep")
        sets.write.bucketBy(self.parts, "rep").sortBy("rep").option("path", self.path).saveAsTable(self.name)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``a, b`` whose sets are similar enough.

        The first set of a pair is that of a centre, which may be the centre of very many; a salt of the second one spreads
        them, and a centre's set is sent once per centre and salt.
        """
        sets = self.spark.table(self.name)
        pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(self.parts)).alias("salt"))
        members = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b")), "b")
        centres = pairs.select("a", "salt").distinct().join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a")), "a")
        both = members.join(centres, ["a", "salt"]).select("a", "b", "of_a", "of_b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                linked = []
                for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    shared = len(x) + len(y) - len(np.union1d(x, y))
                    linked.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

        return both.mapInArrow(run, "a long, b long")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _pairs_between(filed: DataFrame) -> DataFrame:
    """``a, b, distance`` of near pairs of different components that share a bucket, each from one bucket only.

    ``filed`` has ``key, slot, rep, comp, n, signature, odd``. Groups arrive sorted, no larger than two blocks, and are compared row by
    row at growing offsets, all groups of a batch at once.
    """
    long = materialise(filed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "long")
    many = filed.join(long, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    spread = many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = spread.select(group.alias("group"), "key", "slot", "rep", "comp", "n", "signature", "odd", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"))
    parts = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "group").sortWithinPartitions("group", "key", "slot", "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])

    def compare(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        size = len(c["rep"])
        new = np.append(True, (c["group"][1:] != c["group"][:-1]) | (c["key"][1:] != c["key"][:-1]))
        number = np.cumsum(new) - 1
        end = np.append(np.flatnonzero(new)[1:], size)[number]
        live, offset = np.arange(size), 0
        while True:
            offset += 1
            live = live[live + offset < end[live]]
            if not len(live):
                return
            for i in range(0, len(live), 1 << 16):
                x = live[i : i + (1 << 16)]
                y = x + offset
                sizes = np.stack([c["n"][x], c["n"][y]])
                ok = (c["comp"][x] != c["comp"][y]) & (100 * sizes.min(axis=0) >= PERCENT * sizes.max(axis=0))
                ok &= (c["side"][x] == -1) & (c["side"][y] == -1) | (c["side"][x] != c["side"][y])
                x, y = x[ok], y[ok]
                differ = c["signature"][x] != c["signature"][y]
                distance = differ.sum(axis=1)
                near = (distance <= DISTANCE) & possible(c["odd"][x], c["odd"][y], c["n"][x] + c["n"][y])
                x, y, differ, distance = x[near], y[near], differ[near], distance[near]
                if not len(x):
                    continue
                errors = np.add.reduceat(differ, _EDGES[:-1], axis=1, dtype=np.int64)
                chunk = (errors <= 1).argmax(axis=1)  # the first chunk in which the pair meets
                inside = differ & (_CHUNK_OF[None, :] == chunk[:, None])
                slot = np.where(inside.any(axis=1), inside.argmax(axis=1), np.array(_EDGES)[chunk])
                here = slot == c["slot"][x]
                a, b = c["rep"][x[here]], c["rep"][y[here]]
                yield arrow_table({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": distance[here].astype(np.int32)}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("group", "key", "slot", "rep", "comp", "n", "side")
        kept: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            c["signature"] = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            c["odd"] = np.frombuffer(b"".join(batch.column("odd").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            if kept is not None:
                c = {k: np.concatenate([kept[k], c[k]]) for k in c}
            last = np.flatnonzero(c["group"] != c["group"][-1])
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield from compare({k: v[:cut] for k, v in c.items()})
            kept = {k: v[cut:] for k, v in c.items()}
        if kept is not None:
            yield from compare(kept)

    return rows.mapInArrow(run, "a long, b long, distance int")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``rep, comp`` after links ``a, b`` between classes."""
    ends = links
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("rep").alias(side), F.col("comp").alias(f"comp_{side}")), side)
    roots = components(ends.select("comp_a", "comp_b")).select(F.col("node").alias("comp"), F.col("root"))
    return materialise(labels.join(roots, "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp")))


def _in_shared_buckets(filed: DataFrame, value: str) -> DataFrame:
    """What is filed in buckets that hold several values, with the smallest one as ``low``.

    Not a window, since a hot bucket would meet in one task: values are aggregated before they are shuffled, and the join is
    one on both sides' own shuffles, which adaptive skew joins can split.
    """
    ends = filed.groupBy("key").agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low != high")
    return filed.join(materialise(ends.select("key", "low"), "ends"), "key")


def _components(docs: DataFrame, classes: DataFrame, text: str) -> DataFrame:
    """``rep, comp`` for every class that shares a bucket with another one."""
    filed = materialise(_in_shared_buckets(postings(classes), "rep").select("key", "slot", "rep", "low"))
    sets = ShingleSets(docs, filed.select("rep").distinct().join(classes.select("rep", "set_id", "low", "low_text"), "rep"), text)
    try:
        return _joined(filed, sets, classes)
    finally:
        sets.drop()


def _joined(filed: DataFrame, sets: ShingleSets, classes: DataFrame) -> DataFrame:
    """``rep, comp`` of the classes that are filed: what confirmed links join, until no bucket holds a pair of components that may be linked."""

    def nearest(stars: DataFrame) -> DataFrame:
        """Of its candidate centres ``a`` each class ``b`` has the nearest, if that is a link."""
        best = _near(stars.distinct(), classes).groupBy("b").agg(F.min(F.struct("distance", "a")).alias("best"))
        return materialise(sets.confirmed(best.select("best.a", "b")))

    first = nearest(filed.where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b"))).select(F.col("b").alias("node"), F.col("a").alias("root"))
    labels = filed.select("rep").distinct().join(follow(first).select(F.col("node").alias("rep"), "root"), "rep", "left")
    labels = materialise(labels.select("rep", F.coalesce("root", "rep").alias("comp")))
    filed = filed.drop("low")

    def open_buckets() -> DataFrame:
        """What is filed in buckets that hold several components."""
        return _in_shared_buckets(filed.join(labels, "rep"), "comp").drop("low")

    for turn in range(1, STARS):
        still = materialise(open_buckets())
        filed = still.drop("comp")  # a bucket of one component stays one
        drawn = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("draw"), "rep", "comp"))
        centres = materialise(still.groupBy("key").agg(drawn.alias("centre")).select("key", F.col("centre.rep").alias("a"), F.col("centre.comp").alias("of")), "centres")
        stars = still.join(centres, "key").where("comp != of").select("a", F.col("rep").alias("b"))
        linked = nearest(stars)
        if linked.isEmpty():
            break
        labels = _merged(labels, linked)
    left = materialise(_pairs_between(materialise(open_buckets(), "open").join(classes.select("rep", "n", "signature", "odd"), "rep")))
    for tries in (*TRIES, None):
        sizes = materialise(labels.groupBy("comp").count(), "sizes")
        for side in ("a", "b"):
            left = left.join(labels.select(F.col("rep").alias(side), F.col("comp").alias(f"comp_{side}")), side)
        left = materialise(left.where("comp_a != comp_b"))
        if left.isEmpty():
            break
        if tries is None:
            chosen = left.select("a", "b")
        else:
            for side in ("a", "b"):
                left = left.join(sizes.select(F.col("comp").alias(f"comp_{side}"), F.col("count").alias(f"size_{side}")), f"comp_{side}")
            smaller = F.when(F.col("size_a") < F.col("size_b"), F.col("comp_a")).otherwise(F.col("comp_b"))
            best = left.groupBy(smaller.alias("owner"), F.pmod(F.xxhash64("a", "b"), F.lit(tries)).alias("draw")).agg(F.min(F.struct("distance", "a", "b")).alias("best"))
            chosen = materialise(best.select("best.a", "best.b").distinct())
        linked = materialise(sets.confirmed(chosen))
        if not linked.isEmpty():
            labels = _merged(labels, linked)
        left = left.select("a", "b", "distance")
        if tries is not None:
            left = left.join(chosen, ["a", "b"], "left_anti")
    return labels


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key``: one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links lead to, its own included; ``kept`` says that it is its own. Null
    and empty texts and those of blanks have an empty set and are linked with nothing. A text of fewer words than a
    shingle is one shingle. Rows without an id take no part and are kept, with a null component. Rows that repeat an id and
    a text are one document, each row with its result. If an id stands for several texts, each of them has the links of its own
    text. An empty table gives none. Other columns are not looked at.
    """
    drawn = materialise(sketches(docs, text), "sketches")
    grouped = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id")
    least = F.min(F.struct("doc_id", "text_key")).alias("least")
    sets = grouped.agg(least, F.min("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("odd").alias("odd"))
    # classes of equal sets have numbers of their own, since an id may stand for several of them
    classes = materialise(
        sets.select(F.monotonically_increasing_id().alias("rep"), "set_id", F.col("least.doc_id").alias("low"), F.col("least.text_key").alias("low_text"), "n", "signature", "odd"), "classes"
    )
    linked = materialise(classes.select("rep", "set_id", "low").join(_components(docs, classes, text), "rep"), "linked")
    smallest = materialise(linked.groupBy("comp").agg(F.min("low").alias("_component")), "smallest")
    linked = lookup_join(linked.select("set_id", "comp"), smallest, ["comp"], ["set_id"]).select("set_id", "_component")
    named = materialise(classes.select("set_id", "low").join(linked, "set_id", "left").select("set_id", F.coalesce("_component", "low").alias("_component")))
    own = F.when(F.col("n_shingles") > 0, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id"))
    return (
        drawn.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
        .join(named, "set_id", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"), "text_key")
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")
    )


def without_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps: one of each group, all of its columns.

    Of rows that repeat an id and a text one stays; null and empty texts belong to no group.
    """
    key, number, kept_id, kept_key = (free_name(docs, n) for n in ("_key", "_number", "_kept_id", "_kept_key"))
    kept = near_duplicates(docs, text).where("kept").select("doc_id", "text_key").distinct().toDF(kept_id, kept_key)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))
    rows = docs.withColumn(key, text_key(text)).join(kept, same, "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", key).orderBy("doc_id"))
    return rows.withColumn(number, first).where(F.col(number) == 1).select(*docs.columns)
