"""Best-fit packing: minimum bin slack over the available piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.scratch import ship, written
from changelens.llm.tokens import word_tokenizer


def token_pieces(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None
) -> DataFrame:
    """Documents as pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32, and row, which numbers them.

    A document is its ids and end_id. Only a longer one is cut, each piece but the last being full. Null text counts
    as empty, which is end_id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, number = word_tokenizer(vocabulary), TaskContext.get().partitionId() << 33
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32")}
            for row, text in enumerate(batch.column(1)):
                data = tokenizer.encode(text.as_py() or "") + end_id.to_bytes(4, "little")
                for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[start : start + 4 * capacity]
                    for column, value in zip(out.values(), (row, piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            ids = batch.column(0).take(pa.array(out.pop("row"), pa.int64()))
            numbers = pa.array(np.arange(number, number + len(ids)), pa.int64())
            number += len(ids)
            columns = [pa.array(v, pa.int32() if name == "piece" else pa.int64()) for name, v in out.items()]
            yield pa.RecordBatch.from_arrays([ids, *columns, numbers], ["doc_id", *out, "row"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long"
    )


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length. Each bin is the fullest that holds the largest length left.

    reach is a bitset of the sums that some of the lengths seen so far can make; adding a length is one shift. The
    first time that a sum appears is noted as the length that made it, which is enough to walk back from the fullest
    sum to its members. Lengths are tried from the largest, each as often as it is there and fits.
    """
    order = np.argsort(-lengths, kind="stable")
    by_length: dict[int, list[int]] = {}
    for i in order.tolist():
        by_length.setdefault(int(lengths[i]), []).append(i)
    available = list(by_length)  # from the largest down
    bins = np.empty(len(lengths), dtype=np.int64)
    current = 0
    while available:
        seed = available[0]
        room = capacity - seed
        chosen = [seed]
        if room:
            reach, mask, steps = 1, (1 << (room + 1)) - 1, []
            for length in available:
                if length > room:
                    continue
                for _ in range(min(len(by_length[length]) - (length == seed), room // length)):
                    grown = reach | (reach << length & mask)
                    if grown == reach:
                        break
                    steps.append((length, grown & ~reach))
                    reach = grown
                if reach >> room & 1:
                    break
            left = reach.bit_length() - 1
            for length, fresh in reversed(steps):
                if fresh >> left & 1:
                    chosen.append(length)
                    left -= length
        for length in chosen:
            bins[by_length[length].pop()] = current
        for length in set(chosen):
            if not by_length[length]:
                del by_length[length]
                available.remove(length)
        current += 1
    return bins


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, group_rows: int = 8192) -> DataFrame:
    """Pieces with the sequence that holds them and their offset there.

    pieces are a written table of token_pieces. They are dealt by a hash of their numbers to groups of about
    group_rows, each packed by one task with minimum_bin_slack, so a task's memory doesn't grow with the input,
    however often a piece is repeated; a group wastes at most about one sequence. Sequence numbers hold the group in
    their upper half. Repeated pieces are packed one by one; an empty table gives an empty result.
    """
    ship(pieces.sparkSession)
    groups = max(1, -(-pieces.count() // group_rows))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True])
        found = minimum_bin_slack(rows["length"].to_numpy(), capacity)
        rows = rows.assign(sequence_id=rows["pack_group"].astype("int64") * (1 << 32) + found)
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows[[*kept, "sequence_id", "offset"]]

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*kept).schema)
    return (
        pieces.select(*kept, "row", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("pack_group"))
        .groupBy("pack_group")
        .applyInPandas(pack, f"{schema}, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, *, capacity: int = 2048, group_rows: int = 8192, **options) -> DataFrame:
    """Documents as pieces in sequences. See token_pieces and pack_pieces for nulls, long texts and repeats."""
    return pack_pieces(written(token_pieces(docs, capacity=capacity, **options), "pieces"), capacity=capacity, group_rows=group_rows)
