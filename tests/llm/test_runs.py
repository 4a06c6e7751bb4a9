from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entries
from ferrylog.llm import runs
from tools.check import compare, connect


def brute(w):
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                found.add((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(rng, most):
    w = []
    while len(w) < rng.randrange(most):
        block = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 9))]
        w += (block * rng.randrange(1, 8))[: rng.randrange(1, 60)]
    return w


def test_find_runs_like_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        texts = [made(rng, 80) for _ in range(rng.randrange(1, 4))]
        start, end, period = runs.find_runs(np.array(sum(texts, []), np.int64), np.array([k for k, w in enumerate(texts) for _ in w], np.int64))
        want, before = [], 0
        for w in texts:
            want += [(s + before, n, q) for s, n, q in brute(w)]
            before += len(w)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == want


@pytest.mark.parametrize("stride", [1, 5])
def test_small_strides(monkeypatch, stride):
    monkeypatch.setattr(runs, "STRIDE", stride)
    monkeypatch.setattr(runs, "TOGETHER", 2)
    test_find_runs_like_brute_force()


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, None if best[1] is None else 1000 * best[1] // best[2], sha(told.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def rows():
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "a " * 5, "a " * 6, "ab cd " * 7, "A a " * 9, "x\x1cy x\x1cy " * 3, "日 本\v" * 8, "a " * 300 + "b " * 500]
    texts += [" ".join(map(str, made(rng, 200))) for _ in range(60)]
    return [(i - 3, t) for i, t in enumerate(texts)] + [(None, "q " * 7), (None, None), (5, "again " * 8), (5, "again " * 8)]


def test_report(spark):
    given = rows()
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in given], "doc_id long, text string, runs int, start string")
    have = [tuple(r) for r in runs.run_report(df, planted=True).collect()]
    assert sorted(have, key=repr) == sorted((expected(*r) for r in given), key=repr)
    assert runs.run_report(df.limit(0)).collect() == []


def test_whole_results(spark):
    df = spark.createDataFrame([(1, "x y x y x y x y z"), (2, None), (3, "b  a a a a a a a")], "doc_id long, text string")
    have = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(df).collect()}
    assert have == {1: ([(0, 8, 2)], "x y z"), 2: ([], ""), 3: ([(1, 7, 1)], "b a")}


def test_query(spark, folder):
    have = entries.queries()["op12_periodic_runs"](spark, folder).toPandas()
    assert compare(have, connect(folder).execute(entries.oracle_sql()["op12_periodic_runs"]).df()) is None
    assert have["n_runs"].sum() > 0
