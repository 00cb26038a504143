"""Token-ID output: sequences in a keyed random training order, as fixed-stride binary shards."""

from __future__ import annotations

import posixpath
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.llm.scratch import scratch_path, ship, written
from changelens.llm.signatures import mixed
from changelens.llm.tokens import word_tokenizer

#: Up to so many input splits, their offsets are broadcast.
BROADCAST_SPLITS = 200_000


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed bijection of 0..n-1, by cycle-walking.

    A balanced Feistel network permutes 0..4^h - 1, the smallest such range that holds n; what leaves 0..n-1 goes
    through it again until it is back inside, at most four times on average.
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for r in range(rounds):
            left, right = right, left ^ (mixed(right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) % (1 << 64))) & low)
        return left << shift | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def sequences(docs: DataFrame, *, id_col: str, text_col: str, length: int, end_id: int, vocabulary: str | None) -> DataFrame:
    """Documents as sequences of length ids, 16 bits each: (split, place, doc_id, piece, n_tokens, ids).

    A document is its ids and end_id; its last sequence is filled up with end_id. split and place number the rows as
    they are read.
    """
    ship(docs.sparkSession)
    stride = 2 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, split, place = word_tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        fill = np.array([end_id], dtype="<u2").tobytes() * length
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "piece", "n_tokens", "ids")}
            for row, text in enumerate(batch.column(1)):
                ids = np.frombuffer(tokenizer.encode(text.as_py() or ""), dtype="<u4")
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError(f"token id {ids.max()} doesn't fit 16 bits")
                data = ids.astype("<u2").tobytes() + fill[:2]
                for piece, start in enumerate(range(0, len(data), stride)):
                    part = data[start : start + stride]
                    for column, value in zip(out.values(), (row, piece, len(part) // 2, part + fill[len(part) :]), strict=True):
                        column.append(value)
            n = len(out["row"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, split), pa.int32()),
                    pa.array(np.arange(place, place + n), pa.int64()),
                    batch.column(0).take(pa.array(out["row"], pa.int64())),
                    pa.array(out["piece"], pa.int32()),
                    pa.array(out["n_tokens"], pa.int32()),
                    pa.array(out["ids"], pa.binary()),
                ],
                ["split", "place", "doc_id", "piece", "n_tokens", "ids"],
            )
            place += n

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"split int, place long, doc_id {kind}, piece int, n_tokens int, ids binary"
    )


def slotted(rows: DataFrame, *, key: int, shard_rows: int) -> tuple[DataFrame, int]:
    """Sequences with their slot in the training order and its shard; and how many there are.

    A sequence's index is its place behind all earlier splits; the slot is the index under feistel().
    """
    spark = rows.sparkSession
    ship(spark)
    counts = written(rows.groupBy("split").count(), "split-counts")
    n = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("split", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    if counts.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)

    def permute(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), n, key))

    slot = F.pandas_udf(permute, "long", F.PandasUDFType.SCALAR)
    return (
        rows.join(offsets, "split")
        .withColumn("slot", slot(F.col("offset") + F.col("place")))
        .withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("int"))
        .drop("split", "place", "offset"),
        n,
    )


def with_scheme(path: str, stored: DataFrame) -> str:
    """path on the file system that Spark itself takes for one without a scheme, as a file of the table stored shows."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return path
    found = stored.select(F.input_file_name()).first()
    return re.match(r"([a-z][a-z0-9+.-]*:(?://[^/]*)?)?", found[0] if found else "").group() + path


def write_shards(rows: DataFrame, path: str, *, length: int, shard_rows: int, n: int, buffer_bytes: int = 64 << 20) -> DataFrame:
    """shard-00000.bin and so on below path, slot s at byte (s mod shard_rows) * 2 * length of its shard.

    Each task first gathers its sequences by shard, as compressed runs, so that the shuffle moves few, small rows; a
    task holds buffer_bytes of them at most. Runs go to ranges of neighbouring shards, and a task writes its range's
    shards one after the other, in slot order. A shard is written under a name of the attempt's own and then moved, so
    a task that runs again replaces its shards with the same bytes. Returns (shard, first_slot, n_rows, crc32), the
    manifest.
    """
    ship(rows.sparkSession)
    n_shards = max(1, -(-n // shard_rows))
    ranges = min(n_shards, 4096)
    stride = 2 * length

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[list[int], list[bytes]]] = {}
        held = 0

        def runs() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "shard": pa.array(list(found), pa.int32()),
                "slots": pa.array([slots for slots, _ in found.values()], pa.list_(pa.int64())),
                "run": pa.array([zstandard.compress(b"".join(ids)) for _, ids in found.values()], pa.binary()),
            })

        for batch in batches:
            for slot, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slots, parts = found.setdefault(slot // shard_rows, ([], []))
                slots.append(slot)
                parts.append(ids)
                held += len(ids)
            if held > buffer_bytes:
                yield runs()
                found, held = {}, 0
        if found:
            yield runs()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, parts = None, {}

        def close() -> pa.RecordBatch:
            data = b"".join(parts[slot] for slot in sorted(parts))
            name = posixpath.join(root, f"shard-{shard:05d}.bin")
            with system.open_output_stream(f"{name}.{attempt}") as out:
                out.write(data)
            system.move(f"{name}.{attempt}", name)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "first_slot": pa.array([shard * shard_rows], pa.int64()),
                "n_rows": pa.array([len(parts)], pa.int64()), "crc32": pa.array([zlib.crc32(data)], pa.int64()),
            })

        for batch in batches:
            for row_shard, slots, run in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if row_shard != shard:
                    if parts:
                        yield close()
                    shard, parts = row_shard, {}
                data = zstandard.decompress(run)
                parts.update((slot, data[i * stride : (i + 1) * stride]) for i, slot in enumerate(slots))
        if parts:
            yield close()

    runs = rows.select("slot", "ids").mapInArrow(gather, "shard int, slots array<long>, run binary")
    at = F.floor(F.col("shard").cast("long") * ranges / n_shards).cast("int")
    dealt = runs.repartitionById(ranges, at).sortWithinPartitions("shard")
    return written(dealt.mapInArrow(write, "shard int, first_slot long, n_rows long, crc32 long"), "manifest")


def read_slots(spark: SparkSession, path: str, *, length: int, shard_rows: int) -> DataFrame:
    """(slot, ids) of every sequence in the shards below path. A shard is a file of bounded size."""
    ship(spark)
    stride = 2 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                n = len(data) // stride
                ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), n, [None, pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n), pa.int64()), ids], ["slot", "ids"])

    first = F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long") * shard_rows
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select(first.alias("first"), "content").mapInArrow(cut, "slot long, ids binary")


def materialise(
    docs: DataFrame,
    path: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 256,
    shard_rows: int = 8192,
    end_id: int = 0,
    key: int = 20_240_607,
    vocabulary: str | None = None,
) -> tuple[DataFrame, DataFrame, str]:
    """(index, manifest, path): all documents as sequences in a keyed random order, in fixed-stride shards below path.

    index has doc_id, piece, n_tokens, slot and shard of every sequence; slots run from 0 without gaps, so the order
    is read from any slot on by its byte place. Ids must fit 16 bits, as those of the 49k vocabulary do; a larger one is
    an error. A path without a scheme lies on Spark's default file system. A null text counts as
    empty and is one sequence of end_id; repeated rows have sequences of their own; an empty table gives an empty
    index and no shard. The order hangs on key and on how the input is split, not on timing: sequences are written
    once, and what follows reads that table.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-shards")
    rows = written(sequences(docs, id_col=id_col, text_col=text_col, length=length, end_id=end_id, vocabulary=vocabulary), "sequences")
    path = with_scheme(path, rows)
    placed, n = slotted(rows, key=key, shard_rows=shard_rows)
    manifest = write_shards(placed, path, length=length, shard_rows=shard_rows, n=n)
    return placed.select("doc_id", "piece", "n_tokens", "slot", "shard"), manifest, path


def training_order(docs: DataFrame, *, length: int = 256, shard_rows: int = 8192, **options) -> DataFrame:
    """The index of materialise() with each sequence's checksum, as read back from the shards."""
    index, _, path = materialise(docs, length=length, shard_rows=shard_rows, **options)
    if index.isEmpty():
        return index.select("*", F.lit(None).cast("long").alias("ids_crc32"))
    stored = read_slots(docs.sparkSession, path, length=length, shard_rows=shard_rows)
    return index.join(stored.select("slot", F.crc32("ids").alias("ids_crc32")), "slot").select("doc_id", "piece", "n_tokens", "slot", "shard", "ids_crc32")
