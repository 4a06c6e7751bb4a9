from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as pipeline
from ferrylog.llm import learning, mixing, quality
from ferrylog.llm.queries import LEAST_SCORE, OTHER_WEIGHT, RANKS, SEED, WEIGHTS
from test_minhash import brute
from test_secrets import base_spans

MORE = [("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")]


def redacted(text: str | None) -> str | None:
    if text is None:
        return None
    spans = [(s, e) for s, _, _, e in base_spans(text)] + [m.span() for _, p in MORE for m in re.finditer(p, text) if len(m.group()) >= 20]
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in reversed(merged):
        text = text[:s] + "[SECRET]" + text[e:]
    return text


def repetitions(rows: list) -> list[int]:
    group = lambda s: s if s in WEIGHTS else None
    sizes: dict = {}
    for r in rows:
        sizes[group(r["source"])] = sizes.get(group(r["source"]), 0) + len(r["text"] or "")
    share = {g: WEIGHTS.get(g, OTHER_WEIGHT) for g in sizes}
    out = []
    for r in rows:
        g = group(r["source"])
        rate = (share[g] / sum(share.values())) * (1.0 * sum(sizes.values())) / sizes[g]
        first, steps = mixing.poisson_steps(rate)
        draw = int(hashlib.md5(f"{SEED}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 2.0**52
        out.append(first + sum(x <= draw for x in steps[:-1]))
    return out


def test_stages_by_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    good = pipeline.keep_good(spark, docs, folder)
    assert good.columns == columns
    weights = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), learning.fold("doc_id", 5) != 0).astype(float)
    rows = [r.asDict() for r in docs.collect()]
    s = quality.Settings()
    logits = [float(weights[at] @ x) for at, x in quality.sparse(*quality.Featurizer(s.buckets).texts([r["text"] or "" for r in rows]), s)]
    rows = [r for r, x in zip(rows, logits, strict=True) if 1 / (1 + np.exp(-x)) >= LEAST_SCORE]
    assert {r.doc_id for r in good.collect()} == {r["doc_id"] for r in rows} and good.count() == len(rows) < docs.count()

    good.write.parquet(str(tmp_path / "good"))
    single = pipeline.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "good")), folder)
    assert single.columns == columns
    root = brute([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if root[r["doc_id"]][1] == r["doc_id"]]
    assert sorted(r.doc_id for r in single.collect()) == sorted(r["doc_id"] for r in rows)

    single.write.parquet(str(tmp_path / "single"))
    clean = pipeline.redact_secrets(spark, spark.read.parquet(str(tmp_path / "single")), folder)
    assert clean.columns == columns
    for r in rows:
        new = redacted(r["text"])
        if new != r["text"]:
            r |= {"text": new, "n_chars": len(new)}
    assert sorted(map(tuple, clean.collect())) == sorted(tuple(r.values()) for r in rows)
    assert any("[SECRET]" in r["text"] for r in rows)

    clean.write.parquet(str(tmp_path / "clean"))
    mixed = pipeline.mix(spark, spark.read.parquet(str(tmp_path / "clean")), folder)
    assert mixed.columns == columns
    rows = [r for r, n in zip(rows, repetitions(rows), strict=True) for _ in range(n)]
    assert sorted(map(tuple, mixed.collect())) == sorted(tuple(r.values()) for r in rows)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(RANKS), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    have = sorted((r.doc_id, r.ids, r.decoded_sha256) for r in pipeline.run(spark, folder).collect())
    assert have == sorted((r["doc_id"], tik.encode_ordinary(r["text"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows)


CLASHING = ("_key", "score", "_found", "mix_copy", "row", "_known", "_kept_id", "_kept_key", "mix_key", "_blob", "_number", "_merged", "_cut", "_draw", "rep", "text_key", "label")


def test_odd_tables(spark, folder):
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    schema = plain + "".join(f", {name} int" for name in CLASHING)
    rows = [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0), (2, None, "en", None, 5), (3, "token=abcdefghijkl " * 20_000, "en", "src1", 1)]
    more = tuple(range(len(CLASHING)))
    wide = spark.createDataFrame([(*r, *more) for r in rows], schema)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns
        have = out.collect()
        assert have and all(tuple(r)[5:] == more for r in have)
        assert {r.doc_id for r in have} <= {None, 1, 2, 3}
    assert pipeline.drop_near_copies(spark, wide, folder).count() == 4
    last = pipeline.STAGES[-1][1](spark, wide, folder).collect()
    assert len(last) == 5
    empty = spark.createDataFrame([], plain)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []
