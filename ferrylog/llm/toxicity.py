"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text is read as overlapping windows of words. A word's input is the embedding of the word beside the summed embeddings
of its character n-grams. Two gated recurrent layers run over a window in either direction; attention pools their
states into one score per window, and a text's score is a logistic function of its highest window scores and its number
of windows. Everything is trained in numpy, on windows of labelled texts: of each text the windows that the network
holds most toxic take the text's label.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylog.llm.common import MULTIPLIER, bounded_batches, mix, small_pieces
from ferrylog.llm.learning import labelled_sample

WORD = re.compile(r"\w+")
Model = dict[str, np.ndarray]
TOP = 4  # how many of the highest windows of a text its score looks at


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows learned from and ``longest`` the length of their texts (in characters)."""

    window: int = 48
    stride: int = 24
    hidden: int = 8
    word_buckets: int = 1 << 16
    word_size: int = 4
    gram_buckets: int = 1 << 15
    gram_size: int = 4
    grams: tuple[int, ...] = (3, 5)
    sample: int = 6000
    longest: int = 20_000
    passes: int = 5
    least_steps: int = 300  # few texts are passed over more often
    batch: int = 64
    rate: float = 0.01
    blank: float = 0.25  # share of words that a training step does not see
    longest_word: int = 64  # longer words are read as overlapping pieces of this length


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.reciprocal(x, out=x)


class Vocabulary:
    """Buckets of words and of their character n-grams, by the order in which words are first met; row 0 is padding."""

    def __init__(self, s: Settings, most: int = 150_000):
        self.s, self.most = s, most
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.words, self.grams, self.counts = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)

    def codes(self, split: list[list[str]]) -> np.ndarray:
        """The place of each word. Words not met before are added, in a stable order."""
        place = self.place
        flat = [w for words in split for w in words]
        new = [w for w in dict.fromkeys(flat) if w not in place]
        if new:
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            self.words = np.append(self.words, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)) % np.uint64(self.s.word_buckets)).astype(np.int64)
            grams, counts = character_grams(new, self.s)
            self.grams, self.counts = np.append(self.grams, grams), np.append(self.counts, counts)
        return np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))


def character_grams(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words (ends marked), word after word, and their number per word."""
    marked = [f"^{w}$" for w in words]
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    firsts = np.cumsum(sizes) - sizes
    found, owners = [], []
    for n in s.grams:
        counts = np.maximum(sizes - n + 1, 0)
        owner = np.repeat(np.arange(len(words)), counts)
        at = firsts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        hashes = np.full(len(at), n, np.uint64)
        for j in range(n):
            hashes = hashes * MULTIPLIER + letters[at + j]
        found.append((mix(hashes) % np.uint64(s.gram_buckets)).astype(np.int64))
        owners.append(owner)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.bincount(owner, minlength=len(words))


def grams_of(vocabulary: Vocabulary, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the words at some places, word after word, and their number per word."""
    counts = vocabulary.counts[at]
    firsts = (np.cumsum(vocabulary.counts) - vocabulary.counts)[at]
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return vocabulary.grams[np.repeat(firsts, counts) + inside], counts


def split_texts(texts: list[str], s: Settings) -> list[list[str]]:
    """The words of each text; pieces of longer words overlap so that each n-gram lies in one of them."""
    shared, split = max(s.grams) - 1, [WORD.findall(t.lower()) for t in texts]
    for i, words in enumerate(split):
        if max(map(len, words), default=0) > s.longest_word:
            split[i] = [w[j : j + s.longest_word] for w in words for j in range(0, max(len(w) - shared, 1), s.longest_word - shared)]
    return split


def windows(sizes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first position and length of each window of texts of ``sizes`` words laid one after another.

    Windows start every ``stride`` words; the last one ends with its text. A text without words has one empty window.
    """
    counts = np.where(sizes <= s.window, 1, -(-(sizes - s.window) // s.stride) + 1)
    owner = np.repeat(np.arange(len(sizes)), counts)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = np.minimum(index * s.stride, np.maximum(sizes[owner] - s.window, 0))
    return owner, (np.cumsum(sizes) - sizes)[owner] + inside, np.minimum(sizes[owner], s.window)


def word_inputs(m: Model, words: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The inputs of words: the word's embedding beside the sum of its n-grams' over the root of their number."""
    sums = np.add.reduceat(m["gram"][grams], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]
    return np.concatenate([m["word"][words], sums], axis=1).astype(np.float32)


def place_matrix(codes: np.ndarray, first: np.ndarray, length: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Codes by window and step (0 beyond the window's length) and whether a step has a word."""
    steps = np.arange(s.window)[None, :]
    mask = steps < length[:, None]
    if not len(codes):
        return np.zeros(mask.shape, np.int64), mask
    return np.where(mask, codes[np.minimum(first[:, None] + steps, len(codes) - 1)], 0), mask


def window_logits(m: Model, projected: np.ndarray, places: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Scores of windows before the sigmoid. ``projected`` has, per word, the gate inputs of both directions."""
    count, steps = places.shape
    hidden = m["U"].shape[1]
    whole = bool(mask.all())
    heads = np.stack([m["attend"], m["out"]], axis=2)  # direction, hidden, (attention, output)
    told = np.zeros((steps, count, 2), np.float32)
    h = np.zeros((2, count, hidden), np.float32)
    for t in range(steps):
        at = (t, steps - 1 - t)
        x = np.stack([projected[0][places[:, at[0]]], projected[1][places[:, at[1]]]])
        u = h @ m["U"]
        gates = _sigmoid(x[..., : 2 * hidden] + u[..., : 2 * hidden])
        c = np.tanh(x[..., 2 * hidden :] + gates[..., :hidden] * u[..., 2 * hidden :])
        new = c + gates[..., hidden:] * (h - c)
        h = new if whole else np.where(np.stack([mask[:, at[0]], mask[:, at[1]]])[..., None], new, h)
        head = h @ heads
        told[at[0]] += head[0]
        told[at[1]] += head[1]
    a = np.where(mask.T, told[..., 0], -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    return (a * told[..., 1]).sum(axis=0) * mask.any(axis=1) + m["bias"][0]


def project(m: Model, inputs: np.ndarray) -> list[np.ndarray]:
    both = [inputs @ m["W"][d] + m["b"][d] for d in (0, 1)]
    return [x.astype(np.float32) for x in both]


def gradients(m: Model, inputs: np.ndarray, places: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[Model, np.ndarray]:
    """Gradients of the weighted mean log loss over windows: of the dense parameters, and of each step's input."""
    count, steps = places.shape
    hidden = m["U"].shape[1]
    x = inputs[places]  # window, step, input
    g: Model = {k: np.zeros_like(m[k]) for k in ("W", "b", "U", "attend", "out", "bias")}
    states, saved = [], []
    for d in (0, 1):
        order = range(steps) if d == 0 else range(steps - 1, -1, -1)
        h, own, hs = np.zeros((count, hidden), np.float32), {}, np.zeros((count, steps, hidden), np.float32)
        for t in order:
            xw, u = x[:, t] @ m["W"][d] + m["b"][d], h @ m["U"][d]
            gates = _sigmoid(xw[:, : 2 * hidden] + u[:, : 2 * hidden])
            r, z, uc = gates[:, :hidden], gates[:, hidden:], u[:, 2 * hidden :]
            c = np.tanh(xw[:, 2 * hidden :] + r * uc)
            own[t] = (h, r, z, c, uc)
            h = np.where(mask[:, t, None], c + z * (h - c), h)
            hs[:, t] = h
        states.append(hs)
        saved.append((order, own))
    a = sum(states[d] @ m["attend"][d] for d in (0, 1))
    a = np.where(mask, a, -1e9)
    a = np.exp(a - a.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    a = a * mask
    o = sum(states[d] @ m["out"][d] for d in (0, 1))
    pooled = (a * o).sum(axis=1)
    p = 1 / (1 + np.exp(-(pooled + m["bias"][0])))
    dl = ((p - y) * weight / weight.sum()).astype(np.float32)
    g["bias"][0] = dl.sum()
    do, da = dl[:, None] * a, dl[:, None] * a * (o - pooled[:, None])
    dx = np.zeros_like(x)
    for d, (order, own) in enumerate(saved):
        hs = states[d]
        g["out"][d] = np.einsum("bt,bth->h", do, hs)
        g["attend"][d] = np.einsum("bt,bth->h", da, hs)
        later = np.zeros((count, hidden), np.float32)
        for t in reversed(order):
            h, r, z, c, uc = own[t]
            dh = later + do[:, t, None] * m["out"][d] + da[:, t, None] * m["attend"][d]
            on = mask[:, t, None]
            dc = dh * (1 - z) * (1 - c * c) * on
            dz = dh * (h - c) * z * (1 - z) * on
            dr = dc * uc * r * (1 - r)
            dgx = np.concatenate([dr, dz, dc], axis=1)
            dgh = np.concatenate([dr, dz, dc * r], axis=1)
            g["U"][d] += h.T @ dgh
            g["W"][d] += x[:, t].T @ dgx
            g["b"][d] += dgx.sum(axis=0)
            dx[:, t] += dgx @ m["W"][d].T
            later = np.where(on, dh * z, dh) + dgh @ m["U"][d].T
    return g, dx


def _signal(rows: list[np.ndarray], y: np.ndarray, buckets: int) -> np.ndarray:
    """Per bucket how far its share of toxic texts is from chance, in standard deviations, on a signed log scale."""
    toxic, all_ = np.zeros(buckets), np.zeros(buckets)
    for own, label in zip(rows, y, strict=True):
        all_[own] += 1
        toxic[own] += label
    chance = all_ * (y.mean() if len(y) else 0.0)
    z = (toxic - chance) / np.sqrt(chance + 1.0)
    return np.sign(z) * np.log1p(np.abs(z) / 2)


def train(texts: list[str], labels: list[int], s: Settings) -> Model:
    """Train on texts with labels 0 and 1; a fifth of the texts is kept back to calibrate the scores of whole texts."""
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(11)
    split = split_texts(texts, s)
    vocabulary = Vocabulary(s, most=1 << 60)
    codes = vocabulary.codes(split)
    words, everything = vocabulary.words, (vocabulary.words, vocabulary.grams, vocabulary.counts)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes)
    kept = rng.random(len(texts)) < 0.2
    own_words = [np.unique(codes[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
    learn = np.flatnonzero(~kept) if (~kept).any() else np.arange(len(texts))

    size, hidden = s.word_size + s.gram_size, s.hidden
    m: Model = {
        "word": rng.normal(0, 0.05, (s.word_buckets, s.word_size)),
        "gram": rng.normal(0, 0.05, (s.gram_buckets, s.gram_size)),
        "W": rng.normal(0, size**-0.5, (2, size, 3 * hidden)),
        "U": rng.normal(0, 0.5 * hidden**-0.5, (2, hidden, 3 * hidden)),
        "b": np.zeros((2, 3 * hidden)),
        "attend": rng.normal(0, 0.3, (2, hidden)),
        "out": rng.normal(0, 0.5, (2, hidden)),
        "bias": np.array([-1.0]),
        "scale": np.array([1.0] + [0.0] * (TOP + 1)),
    }
    m = {k: v.astype(np.float32) for k, v in m.items()}
    m["word"][:, 0] = _signal([np.unique(words[own_words[i]]) for i in learn], y[learn], s.word_buckets)
    m["gram"][:, 0] = _signal([np.unique(grams_of(vocabulary, own_words[i])[0]) for i in learn], y[learn], s.gram_buckets)

    owner, first, length = windows(sizes, s)
    places, mask = place_matrix(codes, first, length, s)
    dense = ("W", "U", "b", "attend", "out", "bias")
    mean, square, step = {k: np.zeros_like(m[k]) for k in dense}, {k: np.zeros_like(m[k]) for k in dense}, 0
    seen = {k: np.full(len(m[k]), 1e-3, np.float32) for k in ("word", "gram")}

    def all_logits() -> np.ndarray:
        projected = project(m, word_inputs(m, *everything))
        return np.concatenate([window_logits(m, projected, places[i : i + 2048], mask[i : i + 2048]) for i in range(0, len(places), 2048)])

    is_learn = np.zeros(len(texts), bool)
    is_learn[learn] = True
    held = kept if kept.any() else is_learn
    best, lowest, best_turn, turn = dict(m), np.inf, 0, 0
    while True:
        logits = all_logits()
        features = text_features(owner, logits, len(texts))[held]
        scale, loss = calibrate(features, y[held])
        if loss < lowest - 1e-4:
            best, lowest, best_turn = {k: v.copy() for k, v in m.items()} | {"scale": scale}, loss, turn
        if turn >= s.passes and step >= s.least_steps and turn - best_turn >= 2 or turn >= 20 * s.passes or not len(learn):
            return best
        turn += 1
        if turn == 1:
            logits = (word_inputs(m, *everything)[places][..., [0, s.word_size]].sum(axis=2) * mask).max(axis=1)
        ranked = np.lexsort((-logits, owner))
        numbers = np.bincount(owner, minlength=len(texts))
        top = ranked[np.arange(len(ranked)) - (np.cumsum(numbers) - numbers)[owner[ranked]] < 2]
        calm = np.flatnonzero(y[owner] == 0)
        more = rng.choice(calm, min(len(calm), len(texts) // 2), replace=False) if len(calm) else calm
        chosen = np.concatenate([top, more])
        chosen = rng.permutation(chosen[is_learn[owner[chosen]]])
        for i in range(0, len(chosen), s.batch):
            w = chosen[i : i + s.batch]
            target = y[owner[w]]
            seen_places = np.where(rng.random(places[w].shape) < s.blank, 0, places[w])
            met, local = np.unique(seen_places, return_inverse=True)
            flat, counts = grams_of(vocabulary, met)
            inputs = word_inputs(m, words[met], flat, counts)
            local = local.reshape(places[w].shape)
            g, dx = gradients(m, inputs, local, mask[w], target, np.where(target > 0, 2.0, 1.0).astype(np.float32))
            step += 1
            for k in dense:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.999 * square[k] + 0.001 * g[k] ** 2
                m[k] -= s.rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)
            per_word = np.zeros((len(met), size), np.float32)
            np.add.at(per_word, local[mask[w]], dx[mask[w]])
            for k, at, part in (("word", words[met], per_word[:, : s.word_size]), ("gram", flat, np.repeat(per_word[:, s.word_size :] / np.sqrt(counts)[:, None], counts, axis=0))):
                rows, inverse = np.unique(at, return_inverse=True)
                grad = np.zeros((len(rows), part.shape[1]), np.float32)
                np.add.at(grad, inverse, part)
                seen[k][rows] += (grad**2).mean(axis=1)
                m[k][rows] -= 0.02 * grad / np.sqrt(seen[k][rows])[:, None]


def text_features(owner: np.ndarray, logits: np.ndarray, count: int) -> np.ndarray:
    """Per text its ``TOP`` highest window logits, the highest first. How many windows it has says nothing: more of the same text is no more toxic."""
    ranked = np.lexsort((-logits, owner))
    own = owner[ranked]
    numbers = np.bincount(owner, minlength=count)
    place = np.arange(len(own)) - (np.cumsum(numbers) - numbers)[own]
    top = np.full((count, TOP), -8.0)
    near = place < TOP
    top[own[near], place[near]] = np.clip(logits[ranked][near], -8.0, 8.0)
    return top


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and, last, offset of a logistic fit of ``y`` to ``x`` (damped Newton steps, held near the first column); its mean loss."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    start = np.zeros(x.shape[1])
    start[0] = 1.0

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0.0, -np.where(y > 0, 1, -1) * (x @ w)).sum() + 1.0 * ((w - start) ** 2).sum())

    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 2.0 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (p - y) + 2.0 * (w - start))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        if size <= 1e-4 or not np.isfinite(step).all():
            break
        w = w - size * step
    return w.astype(np.float32), loss(w) / max(1, len(y))


class Scorer:
    """Scores texts with a trained model; remembers the gate inputs of a bounded number of words."""

    def __init__(self, m: Model, s: Settings):
        self.m, self.s = m, s
        self.vocabulary = Vocabulary(s)
        self._start()

    def _start(self) -> None:
        self.vocabulary.forget()
        hidden = 3 * self.s.hidden
        self.projected, self.filled = [np.zeros((4096, hidden), np.float32) for _ in (0, 1)], 0

    def _project(self) -> None:
        """Gate inputs of the words added since the last call."""
        v, need = self.vocabulary, len(self.vocabulary.place)
        if need == self.filled:
            return
        while len(self.projected[0]) < need:
            self.projected = [np.concatenate([p, np.zeros_like(p)]) for p in self.projected]
        done = int(v.counts[: self.filled].sum())
        new = project(self.m, word_inputs(self.m, v.words[self.filled :], v.grams[done:], v.counts[self.filled :]))
        for p, x in zip(self.projected, new, strict=True):
            p[self.filled : need] = x
        self.filled = need

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.vocabulary.place) > self.vocabulary.most:
            self._start()
        split = split_texts(texts, self.s)
        codes = self.vocabulary.codes(split)
        self._project()
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        owner, first, length = windows(sizes, self.s)
        logits = np.zeros(len(owner))
        whole = length == self.s.window
        for group in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for i in range(0, len(group), 2048):
                w = group[i : i + 2048]
                logits[w] = window_logits(self.m, self.projected, *place_matrix(codes, first[w], length[w], self.s))
        scale = self.m["scale"].astype(float)
        return 1 / (1 + np.exp(-np.clip(text_features(owner, logits, len(texts)) @ scale[:-1] + scale[-1], -35, 35)))


def _packed(m: Model) -> bytes:
    out = io.BytesIO()
    np.savez(out, **m)
    return out.getvalue()


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", s: Settings = Settings()) -> Model:
    """A model learned from at most ``s.sample`` labelled documents (see :func:`labelled_sample`) for which ``learn`` holds.

    One task trains on that bounded sample. Without labelled rows the model is that of two made-up words.
    """
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, learn, label, s.sample, s.longest)

    def learned(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = list(pieces)
        if pieces:
            rows = pd.concat(pieces, ignore_index=True).sort_values(["turn", "text"])
            yield pd.DataFrame({"model": [_packed(train(rows["text"].tolist(), rows["label"].tolist(), s))]})

    found = sample.repartition(1).mapInPandas(learned, "model binary").collect()
    if not found:
        return train(["a", "b"], [0, 1], s)
    return dict(np.load(io.BytesIO(found[0]["model"])))


def score(docs: DataFrame, model: Model, carried: tuple[str, ...] = ("doc_id",), text: str = "text", s: Settings = Settings()) -> DataFrame:
    """``carried`` columns and ``score`` (0 to 1, higher: label 1 likelier) of each whole text: a logistic fit of its ``TOP`` highest windows.

    All windows are scored, whatever the text's length, and the length itself has no part in the score. Null and empty texts, and those without a word, have the score of an empty window. Equal texts have equal
    scores; an empty table gives none.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(model)  # of fixed size
    chosen = docs.select(*carried, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text"] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shipped.value, s)
        for batch in small_pieces(batches, "_text"):
            kept = [(f, batch.column(f.name)) for f in batch.schema if f.name != "_text"]
            scores = pa.array(own.scores(batch.column("_text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [scores], schema=pa.schema([f for f, _ in kept] + [("score", pa.float64())]))

    return chosen.mapInArrow(run, schema)
