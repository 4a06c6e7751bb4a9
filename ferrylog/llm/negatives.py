"""Hard negatives by exact integer products of anchor and candidate tiles.

Rows are packed into tiles of at most ``TILE`` vectors, anchors likewise; each pair of tiles meets once, as rows of an
equi-join over groups of candidate tiles, to which anchor tiles are dealt. The product of two tiles is Strassen's: seven
products of half the size in place of eight, on int64 with zero padding, down to ``LEAF`` components. Additions of integers are
exact, also where sums of blocks run over, as all is modulo 2**64: a score that fits in 64 bits is the right one.

Two turns: the first keeps, per anchor and tile, a heap of the best rows of the same label; heaps merge by a ranked window that Spark
bounds before the shuffle. Positives then give each anchor a few score windows, and the second turn keeps, per window and tile, a heap
of the best rows of another label inside it, merged the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrylog.llm.common import arrow_table, bounded_batches
from ferrylog.session import materialise

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Vectors of a candidate tile and of an anchor tile, components below which a product is taken directly.
TILE, ANCHOR_TILE, LEAF = 2048, 512, 16
SCALE = 256
_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for int64 matrices, modulo 2**64; odd sides are padded with zeros."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return np.einsum("ik,kj->ij", a, b)
    if rows % 2 or inner % 2 or columns % 2:
        a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
        b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


def whole(vector: str) -> Column:
    """Not null, without null or non-finite components; none so large that its integer is beyond 64 bits."""
    limit = float(2**63 // SCALE)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= limit))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


TILE_FIELDS = [("tile", pa.int64()), ("width", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("values", pa.binary())]
TILE_SCHEMA = "tile long, width long, ids binary, labels binary, values binary"


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """``vec_id, label, vector`` as tiles; rows of a tile are sorted by id. Tiles never span partitions and have ids of their own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows_ in _of_size(batches, most):
            order = np.argsort(rows_.column("vec_id").to_numpy(), kind="stable")
            vectors = rows_.column("vector").combine_chunks()
            lengths = np.diff(vectors.offsets.to_numpy())
            width = int(lengths.max(initial=0))
            values = np.zeros((len(lengths), width), np.int64)
            flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            values[np.arange(width) < lengths[:, None]] = flat
            ids, labels = (rows_.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("vec_id", "label"))
            packed = {"tile": [number], "width": [width], "ids": [ids], "labels": [labels], "values": [values[order].astype("<i8").tobytes()]}
            yield arrow_table(packed, pa.schema(TILE_FIELDS))
            number += 1

    return materialise(rows.mapInArrow(pack, TILE_SCHEMA), "tiles")


def _of_size(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Record batches joined and cut into tables of ``most`` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == most:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Tile:
    """One side of a product, read from columns with a prefix."""

    def __init__(self, row: dict, prefix: str):
        self.number = row[f"{prefix}tile"]
        self.ids = np.frombuffer(row[f"{prefix}ids"], "<i8")
        self.labels = np.frombuffer(row[f"{prefix}labels"], "<i8")
        self.values = np.frombuffer(row[f"{prefix}values"], "<i8").reshape(len(self.ids), row[f"{prefix}width"])


def scores(anchors: Tile, others: Tile) -> np.ndarray:
    """All products of rows; the narrower side is padded with zeros."""
    width = max(anchors.values.shape[1], others.values.shape[1])
    a, b = (np.pad(t.values, ((0, 0), (0, width - t.values.shape[1]))) for t in (anchors, others))
    return strassen(a, np.ascontiguousarray(b.T))


def best(score: np.ndarray, taking_part: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The heap of the highest scores of each row among those taking part: rows, columns and ranks (from 0), ties to the first column."""
    left = np.where(taking_part, score, _LEAST)
    lines = np.arange(len(score))
    found = []
    for rank in range(min(most, score.shape[1])):
        column = left.argmax(axis=1)
        good = left[lines, column] != _LEAST
        found.append((lines[good], column[good], np.full(good.sum(), rank)))
        left[lines, column] = _LEAST
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))  # type: ignore[return-value]


POSITIVE_FIELDS = [(c, pa.int64()) for c in ("tile", "line", "anchor_id", "positive_id", "score")]
WINDOW = ("line", "place", "low", "high")
NEGATIVE_FIELDS = [(c, pa.int64()) for c in ("tile", "line", "place", "negative_id", "score")]


def _positives(row: dict) -> dict[str, np.ndarray]:
    anchors, others = Tile(row, "a_"), Tile(row, "")
    score = scores(anchors, others)
    line, column, _ = best(score, (anchors.labels[:, None] == others.labels) & (anchors.ids[:, None] != others.ids), POSITIVES)
    return {"tile": np.full(len(line), anchors.number), "line": line, "anchor_id": anchors.ids[line], "positive_id": others.ids[column], "score": score[line, column]}


def _negatives(row: dict) -> dict[str, np.ndarray]:
    anchors, others = Tile(row, "a_"), Tile(row, "")
    score = scores(anchors, others)
    apart = anchors.labels[:, None] != others.labels
    windows = np.array(row["a_windows"], np.int64).reshape(-1, len(WINDOW))
    found = []
    for place in range(POSITIVES):
        line, _, low, high = windows[windows[:, 1] == place].T
        inside = (score[line] >= low[:, None]) & (score[line] <= high[:, None]) & apart[line]
        at, column, _ = best(score[line], inside, NEGATIVES)
        found.append((line[at], np.full(len(at), place), others.ids[column], score[line[at], column]))
    line, place, negative, value = (np.concatenate([f[i] for f in found]) for i in range(4))
    return {"tile": np.full(len(line), anchors.number), "line": line, "place": place, "negative_id": negative, "score": value}


def _products(anchors: DataFrame, tiles: DataFrame, groups: int, fields: list, of_pair) -> DataFrame:
    """What ``of_pair`` says of each pair of an anchor tile and a candidate tile."""
    dealt = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    grouped = tiles.withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield arrow_table(of_pair(batch.slice(k, 1).to_pylist()[0]), schema)

    joined = dealt.hint("merge").join(grouped.hint("merge"), "group").drop("group")
    return joined.mapInArrow(run, ", ".join(f"{name} long" for name, _ in fields))


def _leading(rows: DataFrame, by: list[str], other: str, most: int, rank: str) -> DataFrame:
    """Merge heaps: the ``most`` highest scores of each group, ties to the smaller id."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), other)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def hard_negatives(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for all rows for which ``anchor`` (of ``vec_id``) holds.

    Scores are inner products of components turned to ``floor(256 * x)``; missing components of a shorter vector count as zero.
    An anchor's positives are its ``POSITIVES`` best other rows of the same label; each has the ``NEGATIVES`` best rows of other labels
    whose score lies from ``LOW`` to ``HIGH`` hundredths of its own. Ties go to the smaller id; with fewer rows there are fewer results.

    Rows with a null id, label or vector, or a null or non-finite component (or one beyond 2**55) take no part; zero and
    empty vectors do, with products of zero. Repeated rows each stand for themselves, but a row never meets rows of its own id as positives.
    An empty table gives an empty table. Other columns, whatever their names, are not looked at.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    chosen = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    chosen = materialise(chosen.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole("vector")), "vectors")
    tiles = _packed(chosen, TILE)
    asked = chosen.where(anchor)
    anchors = _packed(asked.repartition(max(1, math.ceil(asked.count() / ANCHOR_TILE))), ANCHOR_TILE)
    groups = max(1, tiles.select("tile").count())
    met = _products(anchors, tiles, groups, POSITIVE_FIELDS, _positives)
    positives = materialise(_leading(met, ["tile", "line"], "positive_id", POSITIVES, "_place").withColumn("place", F.col("_place") - 1).drop("_place"), "positives")
    # LOW * p <= 100 * n <= HIGH * p with p = 100 * t + r, on numbers that cannot run over
    t = F.expr("(score - pmod(score, 100)) div 100")
    low, high = LOW * t + F.expr(f"({LOW} * pmod(score, 100) + 99) div 100"), HIGH * t + F.expr(f"({HIGH} * pmod(score, 100)) div 100")
    windows = positives.select("tile", "line", "place", low.alias("low"), high.alias("high")).where("low <= high")
    packed = windows.groupBy("tile").agg(F.collect_list(F.array(*[F.col(c).cast("long") for c in WINDOW])).alias("windows"))  # at most ANCHOR_TILE * POSITIVES
    met = _products(anchors.join(packed, "tile"), tiles, groups, NEGATIVE_FIELDS, _negatives)
    negatives = _leading(met, ["tile", "line", "place"], "negative_id", NEGATIVES, "rank")
    kept = negatives.withColumnRenamed("score", "negative_score").join(positives.withColumnRenamed("score", "positive_score"), ["tile", "line", "place"])
    return kept.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
