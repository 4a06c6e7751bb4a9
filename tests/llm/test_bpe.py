from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ferrylog.llm import bpe
from ferrylog.llm.queries import QUERIES, RANKS

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def entries():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def codec(entries):
    return bpe.Codec(bpe.PerfectHash(entries), PATTERN)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def test_perfect_hash_is_minimal_and_exact(entries):
    index = bpe.PerfectHash(entries)
    assert sorted(index.slots.tolist()) == list(range(len(entries)))
    assert index.find(entries) == list(range(len(entries)))
    assert set(index.find([e + b"\x00\x01" for e in entries[:2000]])) == {-1}
    assert bpe.PerfectHash([]).find([b"a"]) == [-1]


def test_encode_like_tiktoken(codec, tik):
    rng = random.Random(5)
    alphabet = "aeinrst  \n\t.,!éßñ日本語🙂​\x1c\x85'sdlve0123４²ⅷ<|endoftext|>"
    texts = ["", " ", "\n\n  x", "don't we'll", "aaaa" * 5000, "ab" * 3000 + "é" * 999, "\x00\x1c\x1d 　x"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(400)]
    for text, have in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids(have) == tik.encode_ordinary(text), repr(text[:80])
        assert codec.decode(have) == text.encode()


def test_query_over_whole_table(spark, folder, tik):
    have = {r.doc_id: r for r in QUERIES["op10_byte_bpe"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(have) == len(docs)
    for d in docs:
        want = tik.encode_ordinary(d.text or "")
        row = have[d.doc_id]
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, "x y", "a"), (1, "x y", "a"), (None, "", "b"), (2, "word " * 40_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "n_tokens")
    have = sorted((tuple(r) for r in bpe.token_digests(df, PATH, PATTERN).select("doc_id", "n_tokens").collect()), key=str)
    assert have == sorted([(1, 0), (1, 2), (1, 2), (None, 0), (2, 40_001)], key=str)
    round_trip = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH)
    assert sorted(bytes(r.bytes).decode() for r in round_trip.collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe.token_digests(df.limit(0), PATH, PATTERN).collect() == []
