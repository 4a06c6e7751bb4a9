"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a vocabulary entry is answered by
one probe. Tier two, for the misses, merges bytes: the parts are a doubly linked list, the mergeable neighbours a heap
ordered by rank and then by place, so a pre-token of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylog.llm.common import arrow_table, bounded_batches, mix, small_pieces

#: Pre-tokens whose ids a worker remembers between batches; when full, those not met again until the next time are forgotten.
REMEMBERED = 250_000


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file (base64 text, blank, rank on each line), by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(entry) for entry, rank in (line.split() for line in file if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash by hash and displace: n keys fill n slots, each found by one probe.

    Keys fall into buckets of about four. Buckets are placed largest first, each with the first seed that sends its
    keys to free, different slots; a bucket of one key stores its slot itself (as a negative number).
    """

    AT_ONCE = 32  # seeds tried together

    def __init__(self, keys: list[bytes]):
        self.keys = keys
        size, hashes = len(keys), self.hashes(keys)
        self.buckets = max(1, size // 4)
        buckets: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate((hashes % np.uint64(self.buckets)).tolist()):
            buckets[b].append(i)
        self.seeds = np.zeros(self.buckets, np.int64)
        self.slots = np.full(size, -1, np.int64)
        taken = np.zeros(size, bool)
        for b in sorted(range(self.buckets), key=lambda b: -len(buckets[b])):
            members = buckets[b]
            if len(members) < 2:
                break
            for first in range(1, 1 << 20, self.AT_ONCE):
                places = self._places(hashes[members][None, :], np.arange(first, first + self.AT_ONCE, dtype=np.uint64)[:, None], size)
                ordered = np.sort(places, axis=1)
                fits = np.flatnonzero(~taken[places].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                if len(fits):
                    break
            else:
                raise ValueError("keys repeat")
            self.seeds[b] = first + fits[0]
            taken[places[fits[0]]] = True
            self.slots[places[fits[0]]] = members
        free = iter(np.flatnonzero(~taken).tolist())
        for b, members in enumerate(buckets):
            if len(members) == 1:
                place = next(free)
                self.seeds[b] = -place - 1
                self.slots[place] = members[0]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    @staticmethod
    def _places(hashes: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
        return (mix(hashes ^ (seeds * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """The index of each key, -1 for what is no key."""
        if not keys or not self.keys:
            return [-1] * len(keys)
        hashes = self.hashes(keys)
        seeds = self.seeds[hashes % np.uint64(self.buckets)]
        places = np.where(seeds < 0, -seeds - 1, self._places(hashes, np.maximum(seeds, 0).astype(np.uint64), len(self.keys)))
        own = self.keys
        return [i if i >= 0 and own[i] == key else -1 for i, key in zip(self.slots[places].tolist(), keys, strict=True)]


class Codec:
    """Encodes and decodes with the entries of one vocabulary and the pattern that splits texts into pre-tokens."""

    def __init__(self, index: PerfectHash, pattern: str):
        self.index, self.entries = index, index.keys
        entries = self.entries
        self.split = regex.compile(pattern).findall
        self.ranks = {entry: rank for rank, entry in enumerate(entries)}
        self.longest = max(map(len, entries), default=0)
        self.single = [self.ranks.get(bytes([b])) for b in range(256)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token that is no entry: always merge the neighbours of the lowest rank, the leftmost first."""
        n, get, longest, push, pop = len(piece), self.ranks.get, self.longest, heapq.heappush, heapq.heappop
        end = list(range(1, n + 1))  # of the part that starts here; 0 for a place inside a part
        before = list(range(-1, n))
        ids = [self.single[b] for b in piece]  # of the part that starts here
        if None in ids:
            raise ValueError("the vocabulary lacks a byte")
        # an entry is rank, start and end in one number, so that the lowest rank and then the leftmost comes first
        bits = n.bit_length()
        mask, high = (1 << bits) - 1, 2 * bits
        heap = [r << high | i << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            left, stop = top >> bits & mask, top & mask
            middle = end[left]
            if not middle or middle == n or end[middle] != stop:  # one of the two has been merged meanwhile
                continue
            end[left], end[middle], ids[left] = stop, 0, top >> high
            if stop < n:
                before[stop] = left
                further = end[stop]
                if further - left <= longest and (r := get(piece[left:further])) is not None:
                    push(heap, r << high | left << bits | further)
            prior = before[left]
            if prior >= 0 and stop - prior <= longest and (r := get(piece[prior:stop])) is not None:
                push(heap, r << high | prior << bits | stop)
        return [x for x, e in zip(ids, end, strict=True) if e]

    def learn(self, pretokens: set[str]) -> None:
        """Resolve pre-tokens not met lately: all by the perfect hash, what it misses by merging."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for t in pretokens.difference(known):
            if (ids := older.get(t)) is not None:
                known[t] = ids
            else:
                new.append(t)
        pieces = [t.encode() for t in new]
        for text, piece, rank in zip(new, pieces, self.index.find(pieces), strict=True):
            ids = (rank,) if rank >= 0 else self.merge(piece)
            known[text] = struct.pack(f"<{len(ids)}I", *ids)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, tokens)) for tokens in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple, Codec] = {}  # one per vocabulary and pattern in a worker process


def codec(key: tuple, index: PerfectHash, pattern: str) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(index, pattern)
    return _CODECS[key]


BOTH = pa.schema([("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
TOKENS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS = pa.schema([("ids", pa.list_(pa.int64()))])


def _encoded(docs: DataFrame, path: str, pattern: str, carried: list[str], text: str, added: pa.Schema, columns) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    entries = read_ranks(path)
    key = (hashlib.sha256(b"".join(base64.b64encode(x) + b"," for x in entries)).hexdigest(), pattern)
    shipped = spark.sparkContext.broadcast(PerfectHash(entries))  # a vocabulary: its size does not follow the data
    chosen = docs.select(*[F.col(c) for c in carried], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    names = {"int64": "long", "string": "string", "list<item: int64>": "array<long>", "list<item: int32>": "array<int>"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text"] + [f"`{f.name}` {names[str(f.type)]}" for f in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, shipped.value, pattern)
        for batch in small_pieces(batches, "_text"):
            ids = own.encode_batch(batch.column("_text").to_pylist())
            new = arrow_table(columns(own, ids), added)
            kept = [(f, batch.column(f.name)) for f in batch.schema if f.name != "_text"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + new.columns, schema=pa.schema([f for f, _ in kept] + list(added)))

    return chosen.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns and ``ids``, the token ids of each whole text (array of long).

    ``path`` is a rank file the driver can read; ``pattern`` splits texts into pre-tokens. A null or empty text has an
    empty array; equal rows stay equal rows; an empty table gives an empty table. Other columns, whatever their
    names, are not looked at.
    """
    return _encoded(docs, path, pattern, list(carried), text, IDS, lambda own, ids: {"ids": [np.frombuffer(x, "<u4").astype(np.int64) for x in ids]})


def decode(tokens: DataFrame, path: str, ids: str = "ids", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns and ``bytes``, what the ids stand for; null ids give null, an id outside the vocabulary an error."""
    shipped = tokens.sparkSession.sparkContext.broadcast(read_ranks(path))
    chosen = tokens.select(*carried, F.col(ids).cast("array<long>").alias("_ids"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_ids"] + ["bytes binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shipped.value
        for batch in batches:
            texts = [None if x is None else b"".join(entries[i] for i in x) for x in batch.column("_ids").to_pylist()]
            kept = [(f, batch.column(f.name)) for f in batch.schema if f.name != "_ids"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(texts, pa.binary())], schema=pa.schema([f for f, _ in kept] + [("bytes", pa.binary())]))

    return chosen.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode each whole text and decode its ids again; the count of ids and digests of both, in one pass.

    Nulls, empty texts, repeated rows and empty tables as in :func:`encode`.
    """

    return _encoded(docs, path, pattern, list(carried), text, TOKENS, _digests)


def _digests(own: Codec, ids: list[bytes]) -> dict:
    return {
        "n_tokens": [len(x) // 4 for x in ids],
        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
        "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in ids],
    }


def tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns, ``ids`` (array of int) and what :func:`token_digests` says of them, in one pass."""
    return _encoded(docs, path, pattern, list(carried), text, BOTH, lambda own, ids: {"ids": [np.frombuffer(x, "<i4") for x in ids]} | _digests(own, ids))
