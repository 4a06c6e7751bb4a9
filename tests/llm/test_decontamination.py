from __future__ import annotations

import hashlib
import random
import re

import pytest

import __spark_entry__ as entries
from ferrylog.llm import decontamination as d
from tools.check import compare, connect

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    found |= windows[tuple(w[s : s + k])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(seed=3):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "the", "of", "Ünï", "x1", "longword", "another", "日本", "zz", "é"]
    text = lambda n, of=11: rng.choice([" ", ", ", "\n", "\0", "_"]).join(rng.choice(vocabulary[:of]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([0, 3, 5, 9, 10, 11, 30, 400, 12, 25])]
    items += [(3, text(40)), (None, text(15)), (17, items[6][1]), (18, items[6][1].upper()), (6, items[6][1]), (20, None), (21, ".. !"), (22, "onlyword"), (23, "w" * 3000 + " tail")]
    docs = [(0, None), (1, ""), (2, "..."), (None, items[6][1]), (4, "onlyword"), (5, "Only onlyword twice, ONLYWORD"), (5, "again")]
    docs += [(7, "w" * 3000 + " tail " * 2), (8, items[7][1] + " " + items[7][1])]
    for i in range(60):
        part = rng.choice(items)[1] or ""
        at = rng.randrange(len(part) + 1) if rng.random() < 0.4 else 0
        docs.append((100 + i, f"{text(rng.randrange(40))} {part[at:]} {text(rng.randrange(40), rng.choice([1, 3, 11]))}"))
    return docs + [(50, items[7][1])] * 3, items


def found(spark, docs, items):
    left = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, digest int, item_id string")
    right = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, class int")
    return d.contamination(left, right)


NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("shard, piece, chunk", [(d.SHARD_BYTES, d.PIECE_WORDS, d.CHUNK), (2500, 7, 64)])
def test_like_brute_force(spark, monkeypatch, shard, piece, chunk):
    monkeypatch.setattr(d, "SHARD_BYTES", shard)
    monkeypatch.setattr(d, "PIECE_WORDS", piece)
    monkeypatch.setattr(d, "CHUNK", chunk)
    docs, items = tables()
    have = [tuple(r[c] for c in NAMES) for r in found(spark, docs, items).collect()]
    assert sorted(have, key=repr) == brute(docs, items)
    assert 0 < sum(r[5] for r in have) < len(have)


def test_matcher_on_many_texts():
    for seed in range(40):
        docs, items = tables(seed)
        own = d.Matcher([(i, " ".join(words(t)).encode()) for i, (_, t) in enumerate(items) if words(t)])
        have = own.search([None if t is None else t.encode() for _, t in docs])
        want = brute([(k, t) for k, (_, t) in enumerate(docs)], list(enumerate(t for _, t in items)))
        told = [(k, n, sum(s["stop"] - s["start"] for s in spans), len(c)) for k, (n, spans, c) in enumerate(zip(have["n_words"], have["spans"], have["classes"]))]
        assert sorted(told) == sorted(r[:4] for r in want)


def test_shift_table_skips_most_places():
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    own = d.Matcher([(0, text(300).encode())])
    near = d.eight_bytes(d.words_only([text(5000).encode()]))
    assert len(own.tiers) == 1 and len(own.tiers[0].candidates(near)) < len(near) / 100


def test_empty_tables(spark):
    docs, items = tables()
    assert found(spark, docs[:0], items).collect() == []
    clean = found(spark, docs, items[:0]).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items or r.spans for r in clean)


def test_query(spark, folder):
    have = entries.queries()["op13_decontamination"](spark, folder).toPandas()
    assert compare(have, connect(folder).execute(entries.oracle_sql()["op13_decontamination"]).df()) is None
    assert have["contaminated"].any() and not have["contaminated"].all()
