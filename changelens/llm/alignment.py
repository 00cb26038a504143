"""Cross-tokenizer alignment: lockstep merging of two tokenisations of the same bytes, and how often their tokens meet."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.scratch import named, ship, written
from changelens.llm.tokens import _byte_letters

#: Bytes of text that are aligned together, and bytes of a text that one pointer pair goes through.
CHUNK, LANE = 4 << 20, 2048
#: The most frequent id pairs that a task holds with their counts; rarer ones are joined by shuffling.
FREQUENT = 1 << 18


class ByteLevel:
    """A byte-level vocabulary in its library's JSON form, encoded by rank: the same ids, several times as fast."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, ids = _byte_letters(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = [*letters, *(a + b for a, b in merges)]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.encoder = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={as_bytes(t): i for i, t in enumerate(tokens)}, special_tokens={}
        )
        self.ids = np.array([ids[t] for t in tokens], dtype=np.int64)
        self.entries = {ids[t]: as_bytes(t) for t in tokens}
        self.size = max(ids.values()) + 1

    def encode(self, text: str) -> np.ndarray:
        return self.ids[self.encoder.encode_to_numpy(" " + text, disallowed_special=())]


class Pieces:
    """A sentence-piece vocabulary, which itself puts a space before a text."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()

        def as_bytes(i: int) -> bytes:
            piece = self.model.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

        self.entries = {i: as_bytes(i) for i in range(self.size)}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), dtype=np.int64)


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, once a worker."""
    return ByteLevel(a), Pieces(b)


def lengths(tokenizer: ByteLevel | Pieces) -> np.ndarray:
    out = np.zeros(tokenizer.size, dtype=np.int64)
    for i, entry in tokenizer.entries.items():
        out[i] = len(entry)
    return out


@dataclass
class Met:
    """Links and cuts of token lines: places of tokens that overlap, and of those that end together."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def lockstep(a_end: np.ndarray, b_end: np.ndarray, first: np.ndarray, stop: np.ndarray) -> Met:
    """Links and cuts of tokens that end at a_end and b_end on one line of bytes, over the lanes [first, stop).

    A lane is a document or a run of a long one's bytes. The state has a pointer into A, one into B and the stop of each
    lane; in a step, every lane emits the pair it points at, a cut if both end together, and goes on in the line whose
    token ends first, or in both. Finished lanes are taken out. An overlap belongs to the lane in which it begins.
    """
    a, b = np.searchsorted(a_end, first, side="right"), np.searchsorted(b_end, first, side="right")
    begin = np.maximum(np.where(a > 0, a_end[a - 1], 0), np.where(b > 0, b_end[b - 1], 0))
    own = begin >= first  # others began in the lane before, which emits them
    out: list[list[np.ndarray]] = [[], [], [], []]
    while len(a):
        ends_a, ends_b = a_end[a], b_end[b]
        both = ends_a == ends_b
        if own is not None:
            both_own = both & own
            found = a[own], b[own], a[both_own], b[both_own]
            own = None
        else:
            found = a, b, a[both], b[both]
        for column, part in zip(out, found, strict=True):
            column.append(part)
        a, b = a + (ends_a <= ends_b), b + (ends_b <= ends_a)
        going = np.minimum(ends_a, ends_b) < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return Met(*(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out))


def lanes(sizes: np.ndarray, most: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop) of the lanes of documents of so many bytes, laid one behind the other."""
    n = -(-sizes // most)
    doc_end = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = (doc_end - sizes)[doc] + nth * most
    return first, np.minimum(first + most, doc_end[doc])


#: What stands behind an id in a group's text: another one, the group's other side, another group.
SIGNS = ",|;"


@lru_cache(maxsize=2)
def written_ids(n: int) -> list[bytes]:
    """Each id below n as text, with each of the SIGNS behind it."""
    return [f"{i}{sign}".encode() for i in range(n) for sign in SIGNS]


def group_texts(flat_a: np.ndarray, flat_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The groups of each document of so many ids as text: `a1,a2|b1;a3|b2,b3`. Both lines' ids are laid group by group."""
    ends = []
    for flat, cut in ((flat_a, cut_a), (flat_b, cut_b)):
        end = np.zeros(len(flat), dtype=np.int64)
        end[cut] = 1
        ends.append(end)
    group_a, group_b = (np.cumsum(end) - end for end in ends)
    order = np.empty(len(flat_a) + len(flat_b), dtype=np.int64)
    order[np.arange(len(flat_a)) + np.append(0, cut_b + 1)[group_a]] = len(SIGNS) * flat_a + ends[0]
    order[np.arange(len(flat_b)) + (cut_a + 1)[group_b]] = len(SIGNS) * flat_b + 2 * ends[1]
    words = written_ids(int(max(flat_a.max(initial=0), flat_b.max(initial=0))) // 65536 * 65536 + 65536)
    stops = np.cumsum(sizes).tolist()
    return [b"".join(map(words.__getitem__, order[i:j].tolist()))[:-1] for i, j in zip([0, *stops[:-1]], stops, strict=True)]


def align_chunk(texts: list[str | None], a: ByteLevel, b: Pieces, length_a: np.ndarray, length_b: np.ndarray, as_text: bool) -> list[pa.Array]:
    """n_a, n_b, n_groups, n_links, groups, pairs and times of each text."""
    none = np.zeros(0, dtype=np.int64)
    ids_a, ids_b, sizes = [], [], []
    for text in texts:
        found = none, none, 0
        if text:
            x, y, whole = a.encode(text), b.encode(text), (" " + text).encode("utf-8")
            # A byte-level vocabulary splits the bytes it is given and changes none, so A's length says enough.
            if length_a[x].sum() == len(whole) and whole == b"".join(map(b.entries.__getitem__, y.tolist())):
                found = x, y, len(whole)
        for column, value in zip((ids_a, ids_b, sizes), found, strict=True):
            column.append(value)
    n_a, n_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
    flat_a, flat_b = np.concatenate(ids_a), np.concatenate(ids_b)
    met = lockstep(np.cumsum(length_a[flat_a]), np.cumsum(length_b[flat_b]), *lanes(np.array(sizes)))
    doc_of_a = np.repeat(np.arange(len(texts)), n_a)
    n_links = np.bincount(doc_of_a[met.a], minlength=len(texts))
    # Groups: both lines' tokens up to each cut.
    cut_a, cut_b = np.sort(met.cut_a), np.sort(met.cut_b)
    offsets = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
    n_groups = np.bincount(doc_of_a[cut_a], minlength=len(texts))
    if as_text:
        groups = pa.array(group_texts(flat_a, flat_b, cut_a, cut_b, n_a + n_b), pa.binary())
    else:
        lists = lambda ids, cut: pa.ListArray.from_arrays(pa.array(np.append(0, cut + 1), pa.int32()), pa.array(ids, pa.int32()))
        groups = pa.ListArray.from_arrays(offsets(n_groups), pa.StructArray.from_arrays([lists(flat_a, cut_a), lists(flat_b, cut_b)], ["a", "b"]))
    # Each document's distinct pairs of ids, and how many links each has.
    code = (doc_of_a[met.a] << 32) | (flat_a[met.a] * b.size + flat_b[met.b])
    distinct, times = np.unique(code, return_counts=True)
    n_pairs = np.bincount(distinct >> 32, minlength=len(texts))
    return [
        *(pa.array(n, pa.int64()) for n in (n_a, n_b, n_groups, n_links)),
        groups,
        pa.ListArray.from_arrays(offsets(n_pairs), pa.array(distinct & 0xFFFFFFFF, pa.int64())),
        pa.ListArray.from_arrays(offsets(n_pairs), pa.array(times, pa.int32())),
    ]


def chunks(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about CHUNK characters."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def align(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, as_text: bool = False
) -> DataFrame:
    """One row a document: n_a, n_b, n_groups, n_links, groups, pairs and times.

    a is a byte-level vocabulary (a space is put before the text), b a sentence-piece model (which puts one there).
    groups (array of a, b: their ids) are cut where tokens of both end at the same byte; as_text gives them as the bytes of
    `a1,a2|b1;a3|b2,b3`. A link is a token of A and one of
    B whose bytes overlap; pairs are the distinct id pairs linked, as A's id times B's vocabulary plus B's id, and times
    how many links each has. Texts that are null, empty, or that either vocabulary doesn't give back byte by byte have no
    tokens. Texts are aligned whole; long ones in several lanes at once. Repeated rows each give a row, an empty table
    gives an empty result; only the two columns are read.
    """
    ship(docs.sparkSession)
    paths = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizers(*paths)
        sizes = lengths(first), lengths(second)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in chunks(texts):
                columns = align_chunk(texts[part], first, second, *sizes, as_text)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], *columns], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    groups = "binary" if as_text else "array<struct<a:array<int>,b:array<int>>>"
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups {groups}, pairs array<long>, times array<int>"
    return docs.select(F.col(named(id_col)).alias("doc_id"), F.col(named(text_col)).alias("text")).mapInArrow(run, out)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): how many documents of aligned(pairs) hold each pair, and whether no other pair of its A id has more.

    Counts are summed in each task before they are shuffled, so a pair that all documents hold is no hot key.
    """
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").count(), "pair-counts")
    # One row an entry of A's vocabulary at most.
    highest = counts.groupBy(F.floor(F.col("pair") / b_size).alias("a")).agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), F.floor(F.col("pair") / b_size) == F.col("a")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def link_scores(aligned: DataFrame, b_size: int, *, frequent: int = FREQUENT) -> DataFrame:
    """The written table aligned(pairs, times, ...) with n_best, its links whose pair is its A id's best, and count_sum, over its links.

    The `frequent` most frequent pairs go to every task, in a table of that bound; a document's other pairs, of which
    none is frequent and so none is hot, meet their counts in a shuffled join. Both ways give the same sums.
    """
    spark = aligned.sparkSession
    counts = written(pair_counts(aligned, b_size), "pair-scores")
    most = written(counts.orderBy(F.desc("count"), "pair").limit(frequent), "frequent-pairs")
    table = most.orderBy("pair").toPandas()
    shared = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["count"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    own = [c for c in aligned.columns if c not in ("pairs", "times")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = shared.value
        keys = np.append(keys, -1)  # what no pair equals
        count, best = np.append(count, 0), np.append(best, False)
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            n = np.diff(pairs.offsets.to_numpy())
            flat, each = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(batch)), n)
            at = np.searchsorted(keys[:-1], flat)
            hit = keys[at] == flat
            sums = lambda x: np.bincount(doc[hit], weights=x, minlength=len(batch)).astype(np.int64)
            rare = np.bincount(doc[~hit], minlength=len(batch))
            offsets = pa.array(np.append(0, np.cumsum(rare)), pa.int32())
            left = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (flat, each)]
            found = [pa.array(sums((each * best[at])[hit])), pa.array(sums((each * count[at])[hit]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *found, *left], [*own, "n_best", "count_sum", "pairs", "times"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in own)
    part = aligned.mapInArrow(look_up, f"{schema}, n_best long, count_sum long, pairs array<long>, times array<long>")
    part = written(part.withColumn("row", F.monotonically_increasing_id()), "scored-links")
    rare = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    rest = rare.join(counts.join(most.select("pair"), "pair", "left_anti"), "pair")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_count"))
    added = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return part.join(rest, "row", "left").select(*own, added("n_best", "more_best"), added("count_sum", "more_count"))


def alignment_digests(docs: DataFrame, *, frequent: int = FREQUENT, **options) -> DataFrame:
    """Of each document: its tokens, groups and links, how its links rank in the whole table, and the digest of its groups."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = align(docs, as_text=True, **options).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times"
    )
    b_size = sentencepiece.SentencePieceProcessor(model_file=options.get("b") or public_tokenizers.path("piece_bpe_32k.model")).get_piece_size()
    return link_scores(written(aligned, "aligned"), b_size, frequent=frequent)
