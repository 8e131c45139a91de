"""Byte-level BPE encoding and decoding: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import extended, free_name, pick, sealed

#: Encoded pre-tokens of each of the two generations that a worker remembers, of so many characters at most; the older goes when the younger is full.
MEMORY, LONGEST = 200_000, 64


class PerfectHash:
    """A minimal perfect hash over n keys (hash and displace): each has a slot below n of its own.

    A key's 64-bit hash gives its bucket and two numbers; the bucket's displacement d puts it at (a + d * b) mod n. Buckets are placed from the
    largest on, with the first d that hits free slots only; the
    last, of one key each, name their slot directly.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        taken = np.zeros(n, bool)
        self.displace = np.zeros(self.buckets, np.int64)
        bucket, a, b = self._parts(self._hashes(keys))
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, x in enumerate(bucket.tolist()):
            members[x].append(i)
        order = sorted(range(self.buckets), key=lambda x: -len(members[x]))
        self.slot_of = np.zeros(n, np.int64)
        for x in order:
            own = members[x]
            if len(own) < 2:
                break
            d, slots = self._place(taken, a[own], b[own])
            taken[slots], self.displace[x], self.slot_of[own] = True, d, slots
        free = iter(np.flatnonzero(~taken).tolist())
        for x in order:
            if len(members[x]) == 1:
                slot = next(free)
                self.displace[x], self.slot_of[members[x][0]] = -slot - 1, slot

    def _place(self, taken: np.ndarray, base: np.ndarray, step: np.ndarray) -> tuple[int, np.ndarray]:
        """The first displacement that puts a bucket's keys at free slots of their own, looked for 64 at a time."""
        for first in range(0, 1 << 40, 64):
            slots = (base + np.arange(first, first + 64)[:, None] * step) % self.n
            for i in np.flatnonzero(~taken[slots].any(axis=1)).tolist():
                if len(set(slots[i].tolist())) == len(base):
                    return first + i, slots[i]
        raise ValueError("two keys are the same, or have the same hash")

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(key) for key in keys], np.uint64)

    def _parts(self, hashes: np.ndarray):
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
        return (hashes % np.uint64(self.buckets)).astype(np.int64), (mixed >> np.uint64(34)).astype(np.int64), ((hashes >> np.uint64(33)) | np.uint64(1)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """A slot for each key; that of a key outside the set is any."""
        bucket, a, b = self._parts(self._hashes(keys))
        d = self.displace[bucket]
        return np.where(d < 0, -d - 1, (a + np.maximum(d, 0) * b) % self.n)


class Vocabulary:
    """Tokens by rank, found through a perfect hash."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys, self.ranks = [b""] * len(keys), [0] * len(keys)
        for key, slot in zip(keys, self.hash.slot_of.tolist(), strict=True):
            self.keys[slot], self.ranks[slot] = key, ranks[key]
        self.token, self.rank_of = {rank: key for key, rank in ranks.items()}, ranks.get
        self.decimal = {rank: str(rank) for rank in self.token}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A rank file: base64 of the token and its rank on each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def find(self, keys: list[bytes]) -> list[int | None]:
        """The rank of each key that is a token."""
        if not keys:
            return []
        return [self.ranks[slot] if self.keys[slot] == key else None for key, slot in zip(keys, self.hash.slots(keys).tolist(), strict=True)]

    def merge(self, piece: bytes) -> list[int]:
        """Ranks of a piece that is no token: the pair of least rank, the leftmost of equals, is joined until none is a token.

        Parts are linked by their start offsets. The heap holds rank, start and end of pairs
        in one number each, so that it orders by rank and then place; pairs that no longer
        stand are passed over.
        """
        n, rank_of = len(piece), self.rank_of
        width = n.bit_length()
        low, shift = (1 << width) - 1, 2 * width
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(rank << shift) + (i << width) + i + 2 for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            end, i = top & low, top >> width & low
            gone = after[i]
            if gone >= n or after[gone] != end:  # a part that was joined to another has itself as next
                continue
            after[i], after[gone] = end, gone
            if end < n:
                before[end] = i
                stop = after[end]
                if (rank := rank_of(piece[i:stop])) is not None:
                    push(heap, (rank << shift) + (i << width) + stop)
            start = before[i]
            if start >= 0 and (rank := rank_of(piece[start:end])) is not None:
                push(heap, (rank << shift) + (start << width) + end)
        parts, i = [], 0
        while i < n:
            parts.append(rank_of(piece[i : after[i]]))
            i = after[i]
        if None in parts:
            raise ValueError(f"the vocabulary lacks a byte of {piece!r}")
        return parts


class Codec:
    """Encodes and decodes texts with a vocabulary and a pattern of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern, self.known, self.older = vocabulary, regex.compile(pattern), {}, {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null counts as empty."""
        out = []
        for text in texts:
            pieces = self.pattern.findall(text or "")
            if len(self.known) > MEMORY:
                self.known, self.older = {}, self.known
            known, older = self.known, self.older
            if new := set(pieces).difference(known):
                known.update((p, older[p]) for p in new if p in older)
                fresh = [p for p in new if p not in older]
                raw = [p.encode() for p in fresh]
                for piece, own, rank in zip(fresh, raw, self.vocabulary.find(raw), strict=True):
                    known[piece] = (rank,) if rank is not None else tuple(self.vocabulary.merge(own))
            out.append(list(chain.from_iterable(map(known.__getitem__, pieces))))
            if new:
                for piece in [p for p in new if len(p) > LONGEST]:
                    del known[piece]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids' tokens."""
        return b"".join(map(self.vocabulary.token.__getitem__, ids))

    def said(self, ids: list[int]) -> str:
        """The ids as decimals joined by commas."""
        return ",".join(map(self.vocabulary.decimal.__getitem__, ids))


def _opened(raw: bytes, pattern: str) -> Codec:
    """A worker keeps the vocabulary, and what it remembers, from task to task: in a module made for it, as all that comes with a task goes with it."""
    held = sys.modules.setdefault("_held_codec", types.ModuleType("_held_codec"))
    key = hashlib.sha256(raw).digest(), pattern
    if getattr(held, "key", None) != key:
        held.key, held.codec = key, Codec(Vocabulary({base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines())}), pattern)
    return held.codec


def _shared(spark, path: str):
    """The rank file's bytes for the executors; its size does not depend on the documents."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _digests(raw, pattern: str):
    def run(batches):
        codec = _opened(raw.value, pattern)
        for batch in batches:
            ids = codec.encode_batch(batch.column("text").to_pylist())
            said = [hashlib.sha256(codec.said(x).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, ids)), pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(raw, pattern: str, decoded: bool = False):
    def run(batches):
        codec = _opened(raw.value, pattern)
        for batch in batches:
            ids = codec.encode_batch(batch.column("text").to_pylist())
            batch = batch.append_column("_ids", pa.array(ids, pa.list_(pa.int32())))
            yield batch.append_column("_decoded", pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string())) if decoded else batch

    return run


def _decoded(raw, pattern: str):
    def run(batches):
        codec = _opened(raw.value, pattern)
        for batch in batches:
            texts = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, *, ids: str = "ids") -> DataFrame:
    """The documents with a column `ids` (array of int) behind theirs: the tokens of the whole text.

    Each match of the pattern is encoded on its own: a perfect hash finds those that are tokens; others start as bytes and are joined pair by pair,
    least rank first. Special tokens are ordinary text. Documents are encoded one by
    one where they are; nothing is shuffled. Null and empty texts have no ids, repeated rows have theirs each. If there is a column
    `ids` already, the new one is `ids_2`. An empty table gives none.
    """
    plain, names, new = sealed(docs)
    rows = plain.withColumnRenamed(new["text"], "text")
    out = rows.mapInArrow(_encoded(_shared(docs.sparkSession, path), pattern), extended(rows, "_ids", "array<int>"))
    return out.toDF(*docs.columns, free_name(ids, docs.columns))


def round_trip(docs: DataFrame, path: str, pattern: str, *, ids: str = "ids") -> DataFrame:
    """`encode`, with decoded_sha256 (lowercase hex) of the bytes that each document's ids decode to behind.

    Null texts decode to no bytes, like empty ones. If there is a column of a new name already, the new one ends in _2.
    """
    plain, names, new = sealed(docs)
    rows = plain.withColumnRenamed(new["text"], "text")
    out = rows.mapInArrow(_encoded(_shared(docs.sparkSession, path), pattern, True), extended(rows, "_ids", "array<int>").add("_decoded", "string"))
    return out.toDF(*docs.columns, free_name(ids, docs.columns), free_name("decoded_sha256", docs.columns))


def decode(encoded: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """(doc_id, text) of a table with doc_id and ids; null ids give null, bytes that are no UTF-8 are replaced."""
    rows = pick(encoded, doc_id="doc_id", ids=ids)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_decoded(_shared(encoded.sparkSession, path), "."), f"doc_id {kind}, text string")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row (doc_id, n_tokens, ids_sha256, decoded_sha256) for each row: the ids joined by commas, and the bytes that they decode to."""
    rows = pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_digests(_shared(docs.sparkSession, path), pattern), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
