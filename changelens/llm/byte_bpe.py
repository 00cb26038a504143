"""Byte-level BPE encoding and decoding: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from changelens.llm.scratch import named, ship
from changelens.llm.signatures import mixed

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters of text that are split and looked up together; pre-tokens that a task remembers.
CHUNK, REMEMBERED = 1 << 20, 1 << 19


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


class PerfectHash:
    """Slots from 0 to n - 1, one for each of n distinct keys; any other key gets some slot too, so callers compare.

    Keys fall into buckets by a hash. Bucket by bucket, the largest first, a seed is sought that sends the bucket's keys
    to free slots; a bucket of one key names a slot that is left.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 3) -> None:
        h, self.n = hashes(keys), max(1, len(keys))
        self.seeds = np.zeros(-(-self.n // per_bucket), dtype=np.int64)
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        members = np.split(order, np.cumsum(np.bincount(bucket, minlength=len(self.seeds)))[:-1])
        taken = np.zeros(self.n, dtype=bool)
        for b in sorted(range(len(members)), key=lambda i: -len(members[i])):
            own = h[members[b]]
            if len(own) < 2:
                break
            first = 0
            while True:
                seeds = np.arange(first, first + 64, dtype=np.uint64)
                slots = mixed(own[None, :] + seeds[:, None] * _STEP) % np.uint64(self.n)
                apart = (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                good = np.flatnonzero(apart & ~taken[slots].any(axis=1))
                if len(good):
                    break
                first += 64
            self.seeds[b] = first + good[0]
            taken[slots[good[0]]] = True
        single = [b for b in range(len(members)) if len(members[b]) == 1]
        self.seeds[single] = -1 - np.flatnonzero(~taken)[: len(single)]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(len(self.seeds))).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = hashes(keys)
        seed = self.seeds[self._bucket(h)]
        found = mixed(h + np.maximum(seed, 0).astype(np.uint64) * _STEP) % np.uint64(self.n)
        return np.where(seed < 0, -1 - seed, found.astype(np.int64))


class ByteVocabulary:
    """A vocabulary of byte strings with their ranks, which are their ids; every single byte is among them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, keys = ranks, list(ranks)
        self.hash = PerfectHash(keys)
        self.entries: list[bytes] = [b""] * self.hash.n
        for slot, key in zip(self.hash.slots(keys).tolist(), keys, strict=True):
            self.entries[slot] = key
        self.codes = [ranks.get(key, 0).to_bytes(4, "little") for key in self.entries]
        self.bytes_of = {rank: key for key, rank in ranks.items()}

    @classmethod
    def from_file(cls, path: str) -> ByteVocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, piece: bytes) -> bytes:
        """The ids of a pre-token that is no entry, by merging neighbours of the lowest rank, the leftmost first.

        end[i] is where the part that begins at i ends, 0 if none does; before[i] is where the part before it begins.
        A heap holds mergeable pairs as (rank, begin, end); one whose parts have changed since is passed over.
        """
        n, ranks = len(piece), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= stop or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]].to_bytes(4, "little"))
            i = end[i]
        return b"".join(out)

    def resolve(self, pieces: list[str], known: dict[str, bytes]) -> None:
        """Puts the ids of each pre-token into known: by the perfect hash, all at once, or else by merging its bytes."""
        keys = [p.encode("utf-8") for p in pieces]
        for piece, key, slot in zip(pieces, keys, self.hash.slots(keys).tolist(), strict=True):
            known[piece] = self.codes[slot] if self.entries[slot] == key else self.merged(key)


def split_texts(texts: list[str], pattern: regex.Pattern) -> Iterator[tuple[int, list[str]]]:
    """(place of the text, its next pre-tokens); a text of over CHUNK characters comes in several parts."""
    for i, text in enumerate(texts):
        if len(text) <= CHUNK:
            yield i, pattern.findall(text)
            continue
        found = (m[0] for m in pattern.finditer(text))
        while part := list(islice(found, CHUNK >> 2)):
            yield i, part


def encode_batch(texts: list[str], vocabulary: ByteVocabulary, pattern: regex.Pattern, known: dict[str, bytes]) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers. known is what the task remembers; it is emptied when full."""
    out: list[list[bytes]] = [[] for _ in texts]
    held: list[tuple[int, list[str]]] = []

    def flush() -> None:
        if len(known) > REMEMBERED:
            known.clear()
        new = set(chain.from_iterable(part for _, part in held)) - known.keys()
        vocabulary.resolve(list(new), known)
        for i, part in held:
            out[i].append(b"".join(map(known.__getitem__, part)))
        held.clear()

    size = 0
    for i, part in split_texts(texts, pattern):
        held.append((i, part))
        size += len(part)
        if size > CHUNK >> 2:
            flush()
            size = 0
    flush()
    return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]


def vocabulary_of(docs: DataFrame, path: str | None):
    """The vocabulary as a broadcast of its own, fixed size: the driver alone reads the file."""
    ship(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(ByteVocabulary.from_file(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))


def encode_texts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """doc_id and ids, the whole text's ids as little-endian unsigned 32-bit numbers.

    Each match of pattern is a pre-token. If it is an entry of the vocabulary, the perfect hash finds it; otherwise its
    bytes are merged. A null text counts as empty and has no ids. Long texts are split part by part, repeated rows each
    give a row, an empty table gives an empty result. Only the two columns are read. vocabulary is a file of ranks.
    """
    shared = vocabulary_of(docs, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, compiled, known = shared.value, regex.compile(pattern), {}
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode_batch(texts, own, compiled, known), pa.binary())], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(named(id_col)).alias("doc_id"), F.col(named(text_col)).alias("text")).mapInArrow(encode, f"doc_id {kind}, ids binary")


def decode_ids(encoded: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """encoded(doc_id, ids) with decoded, the bytes that the ids stand for. Null ids give null; an unknown id is an error."""
    shared = vocabulary_of(encoded, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = shared.value.bytes_of
        text = lambda ids: None if ids is None else b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([text(x.as_py()) for x in batch.column(1)], pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, ids binary, decoded binary")


def round_trip_digests(docs: DataFrame, **options) -> DataFrame:
    """Of each document, how many ids it has, and the digests of its ids and of the bytes that they decode to."""
    return decode_ids(encode_texts(docs, **options)).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
