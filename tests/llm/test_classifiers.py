from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from ferrylog.llm import learning, quality, toxicity
from ferrylog.llm.queries import QUERIES

SMALL = toxicity.Settings(window=6, stride=4, hidden=3, word_buckets=64, gram_buckets=64, passes=2, least_steps=20, batch=8)


def auc(scores: list[float], labels: list[int]) -> float:
    pairs = [(a > b) + 0.5 * (a == b) for a, x in zip(scores, labels, strict=True) if x for b, y in zip(scores, labels, strict=True) if not y]
    return float(np.mean(pairs))


@pytest.mark.parametrize(("name", "label", "folds", "out", "least"), [("op1_quality_classifier", "quality", 5, 0, 0.97), ("op7_toxicity", "toxic", 4, 2, 0.7)])
def test_held_out_rows(spark, folder, name, label, folds, out, least):
    big = folder.replace("sf0.001", "sf0.01")
    rows = QUERIES[name](spark, big).collect()
    assert len(rows) == spark.read.parquet(f"{big}/documents.parquet").count()
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    kept = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert auc([s for s, _ in kept], [y for _, y in kept]) >= least


def test_quality_dot_is_the_sparse_product():
    s = quality.Settings(buckets=1 << 10)
    f = quality.Featurizer(s.buckets)
    texts = ["", "One two two THREE!!", "  ", "a " * 500, "été 12 — x", "One two"]
    found = f.texts(texts)
    weights = np.random.default_rng(1).normal(size=s.buckets + 1)
    by_rows = [float(weights[at] @ x) for at, x in quality.sparse(*found, s)]
    assert np.allclose(by_rows, quality.dot(*found, weights, s))
    alone = [quality.dot(*quality.Featurizer(s.buckets).texts([t]), weights, s)[0] for t in texts]
    assert np.allclose(alone, by_rows)  # no text looks at its neighbours in the batch


def test_long_runs_of_signs_are_read_whole():
    assert [quality.shape(x) for x in ("--", "-" * 8, "-" * 9, "-" * 400, "-" * 400 + "!", "-=" * 20)] == ["--", "-" * 8, "-+", "-+", "-!+", "-=+"]


def test_equal_texts_have_equal_scores_wherever_they_stand():
    s = quality.Settings(buckets=1 << 10)
    rng = np.random.default_rng(4)
    weights = rng.normal(size=s.buckets + 1)
    made = [" ".join(f"w{i}" for i in rng.integers(0, 500, n)) for n in (1, 3, 50, 777, 4000)]
    texts = ["", *made, made[2], "x", made[4], made[4], made[3], "", *reversed(made)]
    found: dict[str, set] = {}
    for batch in (texts, texts[3:], texts[5:9]):
        for t, value in zip(batch, quality.dot(*quality.Featurizer(s.buckets).texts(batch), weights, s), strict=True):
            found.setdefault(t, set()).add(float(value))
    assert all(len(values) == 1 for values in found.values())


def test_updates_are_those_of_a_plain_loop():
    """Follow-the-regularised-leader, coordinate by coordinate, in the order that training uses."""
    s, rng = quality.Settings(buckets=40, passes=3), np.random.default_rng(8)
    examples = [(np.append(np.sort(rng.choice(40, 6, replace=False)), 40), np.append(rng.random(6), 1.0)) for _ in range(60)]
    labels = rng.integers(0, 2, 60).tolist()
    z, n, order = [0.0] * 41, [0.0] * 41, np.random.default_rng(7)

    def weight(i: int) -> float:
        if abs(z[i]) <= s.l1:
            return 0.0
        return -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.passes):
        for e in order.permutation(60):
            at, x = examples[e]
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, v, old in zip(at, x, w, strict=True):
                g = (p - labels[e]) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
                z[i], n[i] = z[i] + g - sigma * old, n[i] + g * g
    assert np.allclose(quality.train(examples, labels, s), [weight(i) for i in range(41)])


def plain_score(m, s, text: str) -> float:
    """One text, window by window, step by step, word by word."""
    vocabulary = toxicity.Vocabulary(s)
    words = toxicity.split_texts([text], s)[0]
    codes = vocabulary.codes([words])
    grams = np.split(vocabulary.grams, np.cumsum(vocabulary.counts)[:-1])
    inputs = [np.concatenate([m["word"][vocabulary.words[c]], m["gram"][grams[c]].sum(axis=0) / math.sqrt(len(grams[c]))]) for c in codes]
    starts = [0] if len(words) <= s.window else [*range(0, len(words) - s.window, s.stride), len(words) - s.window]
    sigmoid, found = (lambda v: 1 / (1 + np.exp(-v))), []
    for start in starts:
        own = inputs[start : start + s.window]
        attend, out = np.zeros(len(own)), np.zeros(len(own))
        for d in (0, 1):
            h, k = np.zeros(s.hidden), s.hidden
            for t in range(len(own)) if d == 0 else reversed(range(len(own))):
                x, u = own[t] @ m["W"][d] + m["b"][d], h @ m["U"][d]
                r, z = sigmoid(x[:k] + u[:k]), sigmoid(x[k : 2 * k] + u[k : 2 * k])
                c = np.tanh(x[2 * k :] + r * u[2 * k :])
                h = (1 - z) * c + z * h
                attend[t] += h @ m["attend"][d]
                out[t] += h @ m["out"][d]
        share = np.exp(attend - attend.max()) if len(own) else attend
        found.append(float((share / share.sum() * out).sum() if len(own) else 0.0) + float(m["bias"][0]))
    top = [*sorted((min(max(v, -8.0), 8.0) for v in found), reverse=True), *[-8.0] * toxicity.TOP][: toxicity.TOP]
    return float(sigmoid(np.dot(top, m["scale"][:-1]) + m["scale"][-1]))


def test_scores_are_those_of_a_plain_loop():
    s, rng = SMALL, np.random.default_rng(6)
    make = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 8))) for _ in range(n))
    learn = [make(30) for _ in range(40)]
    m = toxicity.train(learn, [i % 2 for i in range(40)], s)
    texts = ["", "!!", "one", make(5), make(6), make(7), make(40), make(41), "x" * 300, *learn[:5]]
    assert np.allclose(toxicity.Scorer(m, s).scores(texts), [plain_score(m, s, t) for t in texts], atol=1e-4)


def test_more_of_the_same_text_is_no_more_toxic(spark, folder):
    big = folder.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model, s = toxicity.fit(docs, labels, learning.fold("doc_id", 4) != 2), toxicity.Settings()
    known = docs.join(labels, "doc_id").where("length(text) between 400 and 3000").orderBy("doc_id").select("text", "toxic").collect()
    scorer = toxicity.Scorer(model, s)
    clean = [r.text for r in known if not r.toxic][:12]
    toxic = [r.text for r in known if r.toxic][:12]
    for text in clean:
        times = -(-100_000 // len(text.split()))
        few, many = scorer.scores([" ".join([text] * 100), " ".join([text] * max(times, 200))])  # windows have met every part of the text, several times
        assert (few >= 0.3) == (many >= 0.3) and abs(few - many) < 1e-4
    around = " ".join(clean[:6])
    while len(around.split()) < 100_000:
        around += " " + around
    alone, inside = scorer.scores(toxic), scorer.scores([f"{around} {t} {around}" for t in toxic])
    assert sum((a >= 0.3) != (b >= 0.3) and a >= 0.3 for a, b in zip(alone, inside, strict=True)) == 0
    huge = " ".join([clean[0]] * (-(-400_000 // len(clean[0].split()))))
    assert (scorer.scores([huge])[0] >= 0.3) == (scorer.scores([" ".join([clean[0]] * 100)])[0] >= 0.3)


def test_network_gradients():
    s, rng = SMALL, np.random.default_rng(3)
    size = s.word_size + s.gram_size
    m = {"W": rng.normal(0, 0.5, (2, size, 9)), "U": rng.normal(0, 0.5, (2, 3, 9)), "b": rng.normal(0, 0.5, (2, 9)), "attend": rng.normal(0, 1, (2, 3)), "out": rng.normal(0, 1, (2, 3)), "bias": np.array([0.2])}
    inputs = rng.normal(0, 1, (20, size))
    places = rng.integers(0, 20, (5, s.window))
    mask = np.arange(s.window)[None, :] < np.array([6, 3, 1, 6, 2])[:, None]
    y, weight = np.array([1.0, 0, 1, 0, 1]), np.ones(5)

    def loss() -> float:
        logits = toxicity.window_logits(m, [inputs @ m["W"][d] + m["b"][d] for d in (0, 1)], places, mask)
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, logits, -logits)))))

    g, dx = toxicity.gradients(m, inputs, places, mask, y, weight)
    for k in g:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in m[k].shape)
            kept = m[k][at]
            m[k][at] = kept + 1e-2
            up = loss()
            m[k][at] = kept - 1e-2
            down = loss()
            m[k][at] = kept
            assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3, k
    assert dx.shape == (5, s.window, size)


def test_windows_cover_texts():
    owner, first, length = toxicity.windows(np.array([0, 3, 6, 7, 23]), SMALL)
    assert owner.tolist() == [0, 1, 2, 3, 3] + [4] * 6
    ends = {o: f + n for o, f, n in zip(owner, first, length, strict=True)}
    assert ends[4] == 39 and ends[3] == 16 and length.max() == 6


def test_long_runs_are_read_whole():
    s, rng = toxicity.Settings(window=6, stride=4, hidden=3, passes=2, least_steps=60, batch=8), np.random.default_rng(5)
    for n in (1, 63, 64, 65, 68, 69, 124, 125, 1000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.split_texts([run], s)[0]
        assert max(map(len, pieces)) <= s.longest_word and (pieces == [run]) == (n <= s.longest_word)
        assert all(any(run[i : i + k] in p for p in pieces) for k in s.grams for i in range(n - k + 1))
    texts, labels = [], []
    for i in range(240):
        words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(40)]
        words[18:18 + 2 * (i % 2)] = ["zwqxvu", "xuvqwz"] * (i % 2)
        texts.append("_".join(words))
        labels.append(i % 2)
    scores = toxicity.Scorer(toxicity.train(texts[:200], labels[:200], s), s).scores(texts[200:])
    assert auc(scores, labels[200:]) >= 0.95


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 1), (2, "", 1), (None, "idiot " * 30_000, 2), (3, "x" * 200_000, 2), (4, "!!!", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 1), (3, 0), (None, 1)], "doc_id long, quality int").selectExpr("*", "quality AS toxic")
    weights = quality.fit(df, labels, learning.fold("doc_id", 5) >= 0)
    model = toxicity.fit(df, labels, learning.fold("doc_id", 4) >= 0, s=SMALL)
    for scored in (quality.score(df, weights), toxicity.score(df, model, s=SMALL)):
        have = scored.collect()
        assert len(have) == len(rows) and all(0 <= r.score <= 1 for r in have)
        assert len({r.score for r in have if r.doc_id == 2}) == 1
    none = labels.limit(0)
    assert {r.score for r in quality.score(df, quality.fit(df, none, learning.fold("doc_id", 5) >= 0)).collect()} == {0.5}
    assert toxicity.score(df.limit(0), toxicity.fit(df, none, learning.fold("doc_id", 4) >= 0, s=SMALL), s=SMALL).collect() == []
