from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
from ferrylog.llm import negatives as n
from tools.check import compare, connect


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (17, 33, 40), (64, 64, 64), (100, 63, 130), (20, 0, 20), (0, 64, 5)])
def test_product_is_exact(shape):
    rng = np.random.default_rng(2)
    rows, inner, columns = shape
    for bits in (9, 30, 62):
        a, b = rng.integers(-(2**bits), 2**bits, (rows, inner)), rng.integers(-(2**bits), 2**bits, (inner, columns))
        want = np.array([[(sum(int(x) * int(y) for x, y in zip(a[i], b[:, j])) + 2**63) % 2**64 - 2**63 for j in range(columns)] for i in range(rows)], np.int64).reshape(rows, columns)
        assert np.array_equal(n.strassen(a, b, leaf=2), want) and np.array_equal(n.strassen(a, b), want)


def brute(rows):
    fit = [(i, lab, [math.floor(256 * np.float32(x).item()) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in fit:
        if i % 50:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))
        others = [(-score(w), j, m) for j, m, w in fit if j != i]
        apart = sorted((s, j) for s, j, m in others if m != lab)
        for s, j in sorted((s, j) for s, j, m in others if m == lab)[: n.POSITIVES]:
            inside = [(t, k) for t, k in apart if 50 * -s <= 100 * -t <= 95 * -s][: n.NEGATIVES]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(inside, 1)]
    return sorted(out)


def vectors():
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 1, 1, 1, 2]), [rng.choice([-1.0, 0.5, 1.0, rng.random()]) for _ in range(9)]) for i in range(400)]
    rows += [(i, rng.choice([0, 1]), [rng.random() for _ in range(rng.choice([0, 3, 14]))]) for i in range(400, 460)]
    rows += [(500, 1, [0.0] * 9), (550, None, [1.0] * 9), (600, 1, None), (650, 1, [1.0, None]), (700, 1, [float("nan")]), (701, 1, [float("inf")]), (None, 1, [1.0]), (703, 1, [1e30])]
    rows += [(800, 0, [1.0] * 9)] * 3 + [(801, 1, [1.0] * 9)] * 7 + [(850, 9, [0.7] * 9)]
    return rows


@pytest.mark.parametrize("tile, anchors", [(n.TILE, n.ANCHOR_TILE), (16, 3)])
def test_like_brute_force(spark, monkeypatch, tile, anchors):
    monkeypatch.setattr(n, "TILE", tile)
    monkeypatch.setattr(n, "ANCHOR_TILE", anchors)
    rows = [(i, lab, v) for i, lab, v in vectors() if v != [1e30]]
    df = spark.createDataFrame([(i, lab, v, 7) for i, lab, v in vectors()], "vec_id long, label int, embedding array<float>, tile int")
    have = n.hard_negatives(df, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in have.collect()) == brute(rows)
    assert have.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert n.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_scores_near_the_bounds_of_64_bits(spark):
    rows = [(0, 0, [2.0**22]), (1, 0, [2.0**22]), (2, 1, [2.0**22 * 0.9]), (3, 1, [2.0**22 * 0.96]), (4, 1, [2.0**21]), (5, 1, [2.0**21 - 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    have = n.hard_negatives(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.negative_id, r.positive_score) for r in have] == [(2, 2**60), (4, 2**60)]


def test_query(spark, folder):
    have = entries.queries()["op11_hard_negatives"](spark, folder).toPandas()
    assert len(have) and compare(have, connect(folder).execute(entries.oracle_sql()["op11_hard_negatives"]).df()) is None
