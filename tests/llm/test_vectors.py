from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
from ferrylog.llm import pivots, projections
from ferrylog.llm.vectors import unit as vectors_unit
from tools.check import compare, connect

SCHEMA = "vec_id long, embedding array<float>, n_links int, score int"
ODD = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, None] + [0.0] * 14, [1.0, 2.0]]


def rows_of(vectors, ids):
    return [(int(i), None if v is None else [None if x is None else float(x) for x in v], 1, 1) for i, v in zip(ids, vectors, strict=True)]


def clustered(seed: int, count: int = 400) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    near = centres[rng.integers(0, 12, count // 2)] + 0.15 * rng.normal(size=(count // 2, 16))
    return np.concatenate([near * rng.uniform(0.1, 9, (len(near), 1)), rng.normal(size=(count - len(near) - 40, 16)), np.tile(centres[:1], (40, 1))]).astype(np.float32)


def cosines(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return v @ v.T


@pytest.mark.parametrize("block", [pivots.BLOCK, 8])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    vectors = clustered(1)
    ids = np.random.default_rng(2).permutation(5000)[: len(vectors)]
    df = spark.createDataFrame(rows_of(list(vectors) + ODD, [*ids, *range(9000, 9000 + len(ODD))]), SCHEMA)
    have = {r.vec_id: r for r in pivots.near_vectors(df).collect()}
    assert len(have) == len(vectors) + len(ODD)
    for i in range(9000, 9000 + len(ODD)):
        assert (have[i].n_links, have[i].component_id, have[i].kept) == (0, i, True)
    linked = cosines(vectors) >= 0.9
    np.fill_diagonal(linked, False)
    found = np.array([have[i].n_links for i in ids])
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.95 * linked.sum()
    index = {int(i): n for n, i in enumerate(ids)}
    reach = linked.copy()
    for _ in range(6):
        reach = reach | (reach.astype(np.float32) @ reach.astype(np.float32) > 0)
    for i in ids.tolist():
        c = have[i].component_id
        assert c <= i and (c == i or reach[index[i], index[c]]) and have[i].kept == (c == i)


def test_pivots_grow_with_the_vectors(spark, monkeypatch):
    assert [pivots.described_by(n) for n in (0, 65_536, 70_000, 1 << 20, 1 << 24, 1 << 40)] == [(256, 7), (256, 7), (264, 8), (1024, 9), (4096, 11), (8192, 12)]
    monkeypatch.setattr(pivots, "PIVOTS", 12)
    assert pivots.described_by(2500) == (50, 10)
    vectors = np.concatenate([clustered(seed, 500) for seed in range(20, 25)])
    df = spark.createDataFrame(rows_of(vectors, range(len(vectors))), SCHEMA)
    linked = cosines(vectors) >= 0.9
    np.fill_diagonal(linked, False)
    found = np.zeros(len(vectors))
    for r in pivots.near_vectors(df).collect():
        found[r.vec_id] = r.n_links
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.95 * linked.sum()


@pytest.mark.parametrize("count", [256, 1024, 4096])
def test_near_vectors_share_two_pivots(count):
    rng = np.random.default_rng(5)
    points, x, other = (vectors_unit(rng.normal(size=(n, 64))) for n in (count, 2000, 2000))
    aside = vectors_unit(other - (other * x).sum(axis=1, keepdims=True) * x)
    prefix = pivots.described_by(count * count)[1]
    near = [np.argsort(-(v @ points.T), axis=1)[:, :prefix] for v in (x, 0.9 * x + math.sqrt(0.19) * aside, other)]
    shared = [(near[0][:, :, None] == v[:, None, :]).sum(axis=(1, 2)) >= 2 for v in near[1:]]
    assert shared[0].mean() >= 0.98 and shared[1].mean() * count < 6


def test_one_tight_cluster_and_repeats(spark):
    rng = np.random.default_rng(3)
    vectors = np.ones((60, 16)) + 0.01 * rng.normal(size=(60, 16))
    rows = rows_of(vectors, range(60)) + rows_of([vectors[0], vectors[0], vectors[5]], [0, 77, 78]) + [(None, [1.0] * 16, 1, 1)]
    have = pivots.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(have) == len(rows)
    assert {(r.n_links, r.component_id) for r in have if r.vec_id is not None} == {(62, 0)}
    assert [(r.n_links, r.component_id, r.kept) for r in have if r.vec_id is None] == [(0, None, True)]
    assert pivots.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(pivots.near_vectors(spark.createDataFrame(rows_of(ODD[:2], [1, 2]), SCHEMA)).collect()) == 2


def several_lengths() -> list:
    rng = np.random.default_rng(8)
    rows = []
    for width, first in ((16, 0), (3, 1000), (2, 2000)):
        centres = rng.normal(size=(4, width))
        vectors = [*(np.repeat(centres, 10, axis=0) + 0.02 * rng.normal(size=(40, width))), centres[0], centres[0]]
        rows += rows_of(vectors, range(first, first + 42))
    return rows + rows_of([[3.0], rows[0][1], rows[60][1]], [50, 1005, 20])  # a length of its own; ids of several vectors


def test_every_length_is_indexed(spark):
    rows = several_lengths()
    df = spark.createDataFrame(rows, SCHEMA)
    ids, n = [r[0] for r in rows], len(rows)
    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) for r in rows]
    cosine = [[float(x @ y) if len(x) == len(y) else -2.0 for y in unit] for x in unit]
    linked = np.array([[i != j and cosine[i][j] >= 0.9 for j in range(n)] for i in range(n)])
    reach = np.linalg.matrix_power(linked + np.eye(n), 8) > 0
    want = sorted((ids[i], int(linked[i].sum()), min(ids[j] for j in np.flatnonzero(reach[i]))) for i in range(n))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in pivots.near_vectors(df).collect()) == want

    have: dict[int, list] = {}
    for r in projections.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        have.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = {i for i in ids if i % 50 == 0}
    assert set(have) == {i for i in asked if any(ids[j] != i and cosine[ids.index(i)][j] > -2 for j in range(n))}
    for q in set(have):
        own = [i for i in range(n) if ids[i] == q]
        best = sorted((-cosine[i][j], ids[j]) for i in own for j in range(n) if ids[j] != q and cosine[i][j] > -2)[:5]
        assert len(have[q]) == 5 and np.allclose([s for _, s in have[q]], [-c for c, _ in best])


def test_chi_square():
    assert math.isclose(projections.chi_square_quantile(0.95, 2), 5.991464547, rel_tol=1e-6)
    assert math.isclose(projections.chi_square_quantile(0.99, 8), 20.09023503, rel_tol=1e-6)


@pytest.mark.parametrize(("cell", "leaf", "at_once"), [(projections.CELL, projections.LEAF, projections.QUERIES_AT_ONCE), (32, 8, 16)])
def test_nearest(spark, monkeypatch, cell, leaf, at_once):
    monkeypatch.setattr(projections, "CELL", cell)
    monkeypatch.setattr(projections.Tree.__init__, "__defaults__", (leaf,))
    monkeypatch.setattr(projections, "QUERIES_AT_ONCE", at_once)
    vectors = clustered(5)
    ids = np.random.default_rng(6).permutation(5000)[: len(vectors)]
    df = spark.createDataFrame(rows_of(list(vectors) + ODD, [*ids, *range(9000, 9000 + len(ODD))]), SCHEMA)
    have: dict[int, list] = {}
    for r in projections.nearest(df, F.col("vec_id") % 7 == 0).orderBy("query_id", "rank").collect():
        have.setdefault(r.query_id, []).append(r)
    queries = [i for i in ids.tolist() if i % 7 == 0]
    assert sorted(have) == sorted(queries)
    s, index, hits = cosines(vectors), {int(i): n for n, i in enumerate(ids)}, 0
    for q in queries:
        rows = have[q]
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in rows}
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        assert all(abs(r.score - s[index[q], index[r.vec_id]]) < 1e-12 for r in rows)
        own = np.delete(s[index[q]], index[q])
        hits += sum(r.score >= np.sort(own)[-5] - 1e-12 for r in rows)
    assert hits >= 0.9 * 5 * len(queries)


def test_nearest_of_few(spark):
    rows = rows_of([[1, 0], [1, 0], [2, 0], [0, 1], [1, 0]], [50, 1, 2, 3, 50]) + [(None, [1.0, 0.0], 1, 1), (100, None, 1, 1)]
    have = [tuple(r) for r in projections.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert have == [(50, 1, 1, 1.0), (50, 2, 2, 1.0), (50, 3, 3, 0.0)]
    assert projections.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    assert projections.nearest(spark.createDataFrame(rows_of([[1, 0]], [50]), SCHEMA), F.lit(True)).collect() == []


def test_query(spark, folder):
    have = entries.queries()["op4_pivot_near_dedup"](spark, folder).toPandas()
    assert compare(have, connect(folder).execute(entries.oracle_sql()["op4_pivot_near_dedup"]).df()) is None


def test_recall_of_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, s = np.array([r.vec_id for r in rows]), cosines(np.array([r.embedding for r in rows], np.float32))
    found: dict[int, set] = {}
    for r in entries.queries()["op8_nearest_neighbours"](spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for n in np.flatnonzero(ids % 50 == 0):
        s[n, n] = -9
        hits += len(found[ids[n]] & set(ids[np.lexsort((ids, -s[n]))[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(found)
