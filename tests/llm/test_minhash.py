from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

import __spark_entry__ as entries
from ferrylog.llm import graph, minhash
from ferrylog.llm.common import WordHashes
from tools.check import compare, connect

BLANKS = " \t\n\v\f\r"


def shingles(text: str | None) -> frozenset:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in BLANKS else c for c in lowered).split(" ")
    words = [w for w in words if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 5 + str(rng.randrange(99))
    return " ".join(words)


def corpus(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \t\v", "One", "one", "a b c d", "A  B\tC\nD", "a b c d e", "é É x\xa0y z w", "é É x\xa0y  z w", "É É x\xa0y z w"]
    for size in (40, 120, 300):
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        texts += [edited(rng, base, rng.randrange(1 + size // 40)) for _ in range(60)]
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [f"{shared} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))) for _ in range(60)]
    texts += ["same text over and over again " * 3] * 40 + ["long " + " ".join(map(str, range(30_000)))] * 2
    ids = rng.sample(range(10**6), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("block", [minhash.BLOCK, 4])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = corpus(7)
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, component_id int, signature string")
    want = brute(docs)
    have = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert len(have) == len(docs)
    for i, (n, component) in want.items():
        assert (have[i].n_shingles, have[i].component_id, have[i].kept) == (n, component, i == component)


def test_all_pairs_within_the_distance_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.integers(0, 1 << 16, minhash.SYMBOLS, dtype=np.uint16)
        y = x.copy()
        y[rng.choice(minhash.SYMBOLS, rng.integers(0, minhash.DISTANCE + 1), replace=False)] ^= 1
        errors = np.add.reduceat(x != y, minhash._EDGES[:-1], dtype=int)
        assert errors.min() <= 1


def test_bucket_pairs_come_once(spark):
    hashes = WordHashes()
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    sets = [minhash.shingle_set(edited(rng, base, rng.randrange(6)), hashes) for _ in range(50)]
    signs = minhash.signatures(sets)
    odd = minhash.odd_sketches(sets)
    classes = spark.createDataFrame([(i, len(s), bytearray(signs[i].tobytes()), bytearray(odd[i].tobytes())) for i, s in enumerate(sets)], "rep long, n long, signature binary, odd binary")
    filed = minhash.postings(classes).join(classes, "rep").selectExpr("key", "slot", "rep", "rep AS comp", "n", "signature", "odd")
    have = sorted((r.a, r.b, r.distance) for r in minhash._pairs_between(filed).collect())
    want = []
    for a, b in itertools.combinations(range(50), 2):
        d = int((signs[a] != signs[b]).sum())
        met = (np.add.reduceat(signs[a] != signs[b], minhash._EDGES[:-1], dtype=int) <= 1).any()
        differ = int(np.bitwise_count(odd[a] ^ odd[b]).sum())
        assert differ <= len(np.setxor1d(sets[a], sets[b]))
        possible = differ * 185 <= (len(sets[a]) + len(sets[b])) * 15
        if d <= minhash.DISTANCE and met and possible and 100 * min(len(sets[a]), len(sets[b])) >= 85 * max(len(sets[a]), len(sets[b])):
            want.append((a, b, d))
    assert have == want


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A B C D E F"), (3, "x y"), (3, "p q"), (4, "p q"), (5, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    have = minhash.near_duplicates(df).collect()
    assert len(have) == len(rows)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in have if r.doc_id in (1, 2)) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert all(r.kept and r.component_id is None for r in have if r.doc_id is None)
    assert {r.component_id for r in have if r.doc_id in (3, 4, 5)} == {3}
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_ids_of_several_texts(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, other = fresh(300), fresh(300)
    near = lambda words: edited(rng, words, 2)
    rows = [(1, " ".join(fresh(80))), (1, near(base)), (2, near(base)), (5, near(base)), (1, near(other)), (7, near(other)), (8, near(other)), (7, " ".join(fresh(50)))]
    rows += [(0, " ".join(fresh(20))) for _ in range(60)] + [(0, near(other)), (9, " ".join(base)), (9, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    have = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    sets = [shingles(t) for _, t in rows]
    linked = [[i == j or 100 * len(x & y) >= 85 * len(x | y) for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    reach = np.linalg.matrix_power(np.array(linked, np.int64), 8) > 0
    want = [(i, len(x), min(rows[j][0] for j in np.flatnonzero(reach[n]))) for n, ((i, _), x) in enumerate(zip(rows, sets, strict=True))]
    assert have == sorted((i, n, c, i == c) for i, n, c in want)
    assert {c for i, _, c in want if i in (2, 5, 9)} == {1} and {c for i, _, c in want if i == 8} == {0}


def test_a_stage_that_fails_leaves_no_table(spark, monkeypatch):
    def fail(*_):
        raise RuntimeError("lost")

    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine {i % 3}") for i in range(9)], "doc_id long, text string")
    monkeypatch.setattr(minhash, "_merged", fail)
    monkeypatch.setattr(minhash.ShingleSets, "confirmed", fail)
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(RuntimeError, match="lost"):
        minhash.near_duplicates(docs)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_components(spark):
    rng = random.Random(4)
    nodes = rng.sample(range(10**9), 400)
    links = [(nodes[i], nodes[i + 1]) for i in range(150)] + [(rng.choice(nodes), rng.choice(nodes)) for _ in range(120)] + [(nodes[0], nodes[0])]
    have = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "x long, y long")).collect()}
    root = {n: n for n in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    assert have == {n: find(n) for a, b in links if a != b for n in (a, b)}
    assert graph.components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_query(spark, folder):
    have = entries.queries()["op6_minhash_near_dedup"](spark, folder).toPandas()
    assert compare(have, connect(folder).execute(entries.oracle_sql()["op6_minhash_near_dedup"]).df()) is None
