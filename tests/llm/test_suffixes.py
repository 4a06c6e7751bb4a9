from __future__ import annotations

import random

import numpy as np
import pytest

import __spark_entry__ as entries
from ferrylog.llm import suffixes
from tools.check import compare, connect


def words_of(text):
    return [bytes(w).lower() for w in (text or "").encode().split()]


def brute(docs):
    n, where = suffixes.LEAST, {}
    for i, t in docs:
        w = words_of(t)
        for s in range(len(w) - n + 1):
            where.setdefault(b" ".join(w[s : s + n]), set()).add(i)
    out = set()
    for i, t in docs:
        w, spans = words_of(t), []
        for s in range(len(w) - n + 1):
            ids = where[b" ".join(w[s : s + n])]
            if len(ids) > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1], spans[-1][2] = s + n, min(spans[-1][2], min(ids))
                else:
                    spans.append([s, s + n, min(ids)])
        out |= {(i, *span) for span in spans}
    return out


def corpus():
    rng = random.Random(3)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 80, 300)]
    docs = []
    for p in passages * 4:
        docs.append(fresh(rng.randrange(60)) + p[: rng.randrange(len(p) // 2, len(p) + 1)] + fresh(rng.randrange(60)))
        docs.append(fresh(rng.randrange(60)) + p + fresh(rng.randrange(60)))
    docs += [fresh(200), ["same"] * 400, ["same"] * 120, fresh(30)] + [passages[4]] * 3
    own = fresh(70)
    docs.append(own + fresh(10) + own)  # repeats within one document only
    texts = [" ".join(d) for d in docs] + [None, "", " \n "]
    texts[5] = texts[5].upper().replace(" ", "\n\t")
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("block", [suffixes.BLOCK, 2])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, words_id int")
    have = suffixes.repeated_passages(df).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.first_id) for r in have} == brute(docs)
    assert len(have) == len(brute(docs)) and all(r.kept == (r.doc_id == r.first_id) and r.n_words == r.end_word - r.start_word for r in have)


def test_every_window_has_its_place():
    grams = np.random.default_rng(1).integers(0, 1 << 60, 500).astype(np.uint64)
    places, firsts = suffixes.chosen_places(grams)
    span = suffixes.LEAST - suffixes.GRAM + 1
    assert firsts[0] == 0 and firsts[-1] == 500 - span + 1
    for p, a, b in zip(places, firsts[:-1], firsts[1:], strict=True):
        for s in range(a, b):
            assert s <= p < s + span and grams[p] == grams[s : s + span].min()


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (2, text + " more"), (3, None), (3, text[:100])]
    have = sorted(tuple(r)[:4] for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert have == [(1, 0, 60, 60), (1, 0, 60, 60), (2, 0, 60, 60)]
    assert suffixes.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, folder):
    have = entries.queries()["op2_suffix_dedup"](spark, folder).toPandas()
    assert compare(have, connect(folder).execute(entries.oracle_sql()["op2_suffix_dedup"]).df()) is None
