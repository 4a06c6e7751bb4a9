"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is cut into words and runs of punctuation. Each token stands for itself (in lower case) and for its shape (case,
length class, digits, the punctuation itself or, in runs of more than 8, its different signs, or "same as the one before"). Features are the hashed 1- and 2-grams
of words and 1- to 3-grams of shapes; a feature's value is its share of the text's n-grams of that family. A score is
the sigmoid of the sparse dot product of these shares with the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylog.llm.common import arrow_table, bounded_batches, mix, small_pieces
from ferrylog.llm.learning import labelled_sample

TOKEN = re.compile(r"\w+|[^\w\s]+")
FAMILIES = 5  # words alone, word pairs, shapes alone, shape pairs, shape triples
SAME = np.uint64(0x5A3E)


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows learned from and ``longest`` the length of their texts (in characters)."""

    buckets: int = 1 << 18
    sample: int = 6000
    longest: int = 20_000
    passes: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.02
    scale: float = 12.0


def shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token if len(token) <= 8 else "".join(dict.fromkeys(token)) + "+"
    if token.isdigit():
        return "0"
    case = "U" if len(token) > 1 and token.isupper() else "T" if token.istitle() else "l" if token.islower() else "m"
    return case + ("3" if len(token) <= 3 else "7" if len(token) <= 7 else "15" if len(token) <= 15 else "+")


class Featurizer:
    """Buckets of the n-grams of texts. Knows each token once; starts afresh beyond ``most`` tokens."""

    def __init__(self, buckets: int, most: int = 300_000):
        import xxhash

        self.buckets, self.most, self.hash = np.uint64(buckets), most, xxhash.xxh3_64_intdigest
        self.place: dict[str, int] = {}
        self.words, self.shapes = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def _codes(self, tokens: list[str]) -> np.ndarray:
        place = self.place
        for t in set(tokens).difference(place):
            i = place[t] = len(place)
            if i == len(self.words):
                self.words, self.shapes = np.concatenate([self.words, self.words]), np.concatenate([self.shapes, self.shapes])
            self.words[i], self.shapes[i] = self.hash(t.lower()), self.hash("shape " + shape(t))
        return np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Numbers of tokens per text, and per family the buckets of all its n-grams, texts one after another.

        A text of n tokens has n n-grams of each family: the first ones of longer n-grams reach over the text's start.
        """
        if len(self.place) > self.most:
            self.place.clear()
        split = [TOKEN.findall(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        codes = self._codes([t for tokens in split for t in tokens])
        if not len(codes):
            return sizes, [np.zeros(0, np.int64)] * FAMILIES
        words, shapes = self.words[codes], self.shapes[codes]
        starts = np.zeros(len(codes), bool)
        starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True

        def before(x: np.ndarray) -> np.ndarray:
            moved = np.concatenate([x[:1], x[:-1]])
            return np.where(starts, np.uint64(1), moved)

        shapes = np.where(before(words) == words, SAME, shapes)
        back = before(shapes)
        odd = np.uint64(0x9E3779B97F4A7C15)
        grams = [words, before(words) * odd + words, shapes + odd, (back * odd + shapes) * odd, ((before(back) * odd + back) * odd + shapes) * odd]
        return sizes, [(mix(g) % self.buckets).astype(np.int64) for g in grams]


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], s: Settings) -> np.ndarray:
    """Weights by FTRL-proximal updates, one example at a time; the last weight is that of the constant."""
    z, n = np.zeros(s.buckets + 1), np.zeros(s.buckets + 1)

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    order = np.random.default_rng(7)
    for _ in range(s.passes):
        for e in order.permutation(len(examples)):
            at, x = examples[e]
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[e]) * x
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / s.alpha * w
            n[at] = squares
    return weights(slice(None))


def sparse(sizes: np.ndarray, families: list[np.ndarray], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and their values, the constant's (1) last."""
    ends = np.cumsum(sizes)
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        at, counts = np.unique(np.concatenate([f[end - size : end] for f in families]), return_counts=True)
        out.append((np.append(at, s.buckets), np.append(counts * (s.scale / max(size, 1)), 1.0)))
    return out


def dot(sizes: np.ndarray, families: list[np.ndarray], weights: np.ndarray, s: Settings) -> np.ndarray:
    """The dot product of each text's values with the weights, without listing distinct buckets first; each text is summed by itself."""
    sums, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        sums[some] = np.add.reduceat(sum(weights[f] for f in families), (np.cumsum(sizes) - sizes)[some])
    return weights[-1] + sums * (s.scale / np.maximum(sizes, 1))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", s: Settings = Settings()) -> np.ndarray:
    """Weights learned from at most ``s.sample`` labelled documents (see :func:`labelled_sample`) for which ``learn`` holds.

    Features are made on the executors; one task then trains on the bounded sample. Without a labelled row all weights
    are 0 and every score is one half.
    """
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, learn, label, s.sample, s.longest)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Featurizer(s.buckets)
        schema = pa.schema([("turn", pa.int64()), ("label", pa.int32()), ("at", pa.binary()), ("x", pa.binary())])
        for batch in small_pieces(batches, "text"):
            rows = sparse(*own.texts(batch.column("text").to_pylist()), s)
            at, x = [a.astype(np.int32).tobytes() for a, _ in rows], [v.astype(np.float32).tobytes() for _, v in rows]
            yield arrow_table({"turn": batch.column("turn"), "label": batch.column("label"), "at": at, "x": x}, schema)

    def learned(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = list(pieces)
        if pieces:
            rows = pd.concat(pieces, ignore_index=True).sort_values(["turn", "at"])
            examples = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(float)) for a, x in zip(rows["at"], rows["x"], strict=True)]
            yield pd.DataFrame({"weights": [train(examples, rows["label"].tolist(), s).astype(np.float32).tobytes()]})

    found = sample.mapInArrow(features, "turn long, label int, at binary, x binary").repartition(1).mapInPandas(learned, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float32).copy() if found else np.zeros(s.buckets + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, carried: tuple[str, ...] = ("doc_id",), text: str = "text", s: Settings = Settings()) -> DataFrame:
    """``carried`` columns and ``score`` (0 to 1, higher: label 1 likelier) of each whole text.

    Null and empty texts have the score of the constant alone. Equal texts have equal scores; an empty table gives none.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(weights)  # of fixed size
    chosen = docs.select(*carried, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text"] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = Featurizer(s.buckets), shipped.value.astype(float)
        for batch in small_pieces(batches, "_text"):
            logits = dot(*own.texts(batch.column("_text").to_pylist()), w, s)
            kept = [(f, batch.column(f.name)) for f in batch.schema if f.name != "_text"]
            scores = pa.array(1.0 / (1.0 + np.exp(-np.clip(logits, -35, 35))), pa.float64())
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [scores], schema=pa.schema([f for f, _ in kept] + [("score", pa.float64())]))

    return chosen.mapInArrow(run, schema)
