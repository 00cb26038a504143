"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.scratch import ship, written
from changelens.llm.signatures import mixed

#: The table number of the exact search over everything, for queries that found too little.
ALL = -1


def perturbations(k: int, n: int) -> np.ndarray:
    """The n likeliest changes of a key of k places, in the order of expected success; a row each, 0 for no change.

    Place j stands for a query's j-th nearest cell border, 2k - 1 - j for the other border of the same cell. The
    expected squared distance to the j-th nearest of 2k uniform borders scores a change; a heap yields sets of changes
    by growing score, from each set by moving its last member on or by adding the next one.
    """
    score = [j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    score += [1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(k + 1, 2 * k + 1)]
    out, heap = [np.zeros(2 * k, dtype=np.int8)], [(score[0], (0,))]
    while heap and len(out) < n:
        total, chosen = heapq.heappop(heap)
        if not any(2 * k - 1 - j in chosen for j in chosen):
            row = np.zeros(2 * k, dtype=np.int8)
            row[list(chosen)] = 1
            out.append(row)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total + score[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*chosen[:-1], last + 1)))
    return np.array(out)


class StableHashes:
    """Tables of k hashes floor((a . v + b) / width), a drawn from a normal distribution, which is 2-stable."""

    def __init__(self, dims: int, width: float, tables: int, k: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.a, self.b = rng.normal(size=(tables, dims, k)), rng.uniform(0, width, size=(tables, 1, k))
        self.width = width

    def cells(self, vectors: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, places inside them from 0 to 1)."""
        at = (vectors @ self.a[table] + self.b[table]) / self.width
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        total = np.zeros(cells.shape[:-1], dtype=np.uint64)
        for i in range(cells.shape[-1]):
            total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + cells[..., i].astype(np.uint64) + np.uint64(1))
        return total.view(np.int64)

    def probes(self, vectors: np.ndarray, table: int, changes: np.ndarray) -> np.ndarray:
        """For each vector the keys to visit, the own one first, then by estimated success."""
        cell, place = self.cells(vectors, table)
        k = cell.shape[1]
        borders = np.argsort(np.concatenate([place, 1 - place], axis=1), axis=1, kind="stable")
        out = np.repeat(cell[:, None, :], len(changes), axis=1)
        rows = np.arange(len(vectors))
        for j in range(2 * k):
            border = borders[:, j]
            out[rows[:, None], np.arange(len(changes))[None, :], (border % k)[:, None]] += np.where(border < k, -1, 1)[:, None] * changes[None, :, j]
        return self.keys(out)


def usable(vector: Column, dims: int) -> Column:
    """Not null, of dims components, all of them finite, one at least not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return (F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0)


def nearest_of(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """(query's place, candidate's place, distance) of each query's k nearest rows but its own, ties by id.

    Squared norms and products choose a few more than k, whose differences then give the distances.
    """
    square = (vectors**2).sum(1)
    for i, q in enumerate(queries):
        about = square - 2 * (vectors @ q)
        about[rows == own[i]] = np.inf
        bound = np.partition(about, k - 1)[k - 1] if len(about) > k else np.inf
        chosen = np.flatnonzero((about <= bound + 1e-9 * (1 + abs(bound))) & np.isfinite(about)) if np.isfinite(bound) else np.flatnonzero(np.isfinite(about))
        distance = np.sqrt(((vectors[chosen] - q) ** 2).sum(1))
        for j in np.lexsort((rows[chosen], ids[chosen], distance))[:k]:
            yield i, chosen[j], distance[j]


def chosen_probes(sample: np.ndarray, hashes: StableHashes, n: int, changes: np.ndarray, recall: float, asking: int = 256) -> tuple[int, float, float]:
    """(probes, recall, share): the fewest probes by which the first `asking` vectors of a sample find that share of their n
    nearest ones in it, what they find by them, and the share of the sample that they compare. All of changes, if none do.

    In a sample neighbours lie farther off than among all rows, so what is found there is found more often in the whole.
    """
    queries = sample[:asking]
    visit = np.full((len(queries), len(sample)), len(changes), dtype=np.int64)
    for t in range(len(hashes.a)):
        keys, probes = hashes.keys(hashes.cells(sample, t)[0]), hashes.probes(queries, t, changes)
        for i, row in enumerate(probes):
            known, first = np.unique(row, return_index=True)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            visit[i] = np.minimum(visit[i], np.where(known[at] == keys, first[at], len(changes)))
    near = np.empty((len(queries), min(n, len(sample) - 1)), dtype=np.int64)
    for i, q in enumerate(queries):
        distance = ((sample - q) ** 2).sum(1)
        distance[i] = np.inf
        near[i] = np.argsort(distance, kind="stable")[: near.shape[1]]
    found = np.sort(np.take_along_axis(visit, near, axis=1).reshape(-1))
    enough = int(found[max(0, int(np.ceil(recall * len(found))) - 1)]) + 1
    probes = min(enough, len(changes))
    return probes, float((found < probes).mean()), float((visit < probes).mean())


def neighbours(
    table: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
    n: int = 10,
    tables: int = 1,
    k: int = 10,
    width: float = 4.0,
    probes: int | None = None,
    recall: float = 0.94,
    most_probes: int = 1024,
    sample: int = 4096,
    bucket_rows: int = 2048,
    seed: int = 5,
) -> DataFrame:
    """Each query's n nearest rows found: query_id, rank, vec_id, score. Queries are rows whose id is a multiple of every.

    Every row is in one bucket of each table, its width being `width` times the vectors' spread along a random line. A
    query visits its own bucket and those that perturbations() names, in that order, as many as probes says, or else as
    chosen_probes() finds on up to `sample` rows, those of the smallest hashes; where they meet, the candidates
    are ranked by exact distance in double precision, and the tables' best are merged. With one table no pair meets
    twice, so a query measures each row once at most. Buckets of more than bucket_rows
    are split by a hash and a query visits all parts, so a hot bucket never lies in one task. A query that finds fewer
    than n, or than there are, is compared with all rows, in the same parts.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
    rows without an id; finite vectors whose squares overflow are no candidates. Ties go to the smaller id. A row is its own query only: repeated rows find each other, and a repeated query has results
    for each row. Without usable vectors the result is empty. The driver holds one random matrix and one row a
    component, and the sample.
    """
    spark = table.sparkSession
    ship(spark)
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    rows = written(rows.filter("id is not null"), "vectors")
    common = rows.filter("size(v) > 0").groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 1
    rows = written(rows.filter(F.coalesce(usable(F.col("v"), dims), F.lit(False))), "usable")
    sums = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s"), F.sum(F.col("x") ** 2).alias("ss"))
    total = rows.count()
    spread = sum(max(0.0, r["ss"] / total - (r["s"] / total) ** 2) for r in sums.collect()) ** 0.5 if total else 1.0
    hashes = StableHashes(dims, max(spread, 1e-12) * width, tables, k, seed)
    if probes is None:
        drawn = rows.orderBy(F.xxhash64("row"), "row").limit(sample).select("v").toPandas()["v"]
        probes = chosen_probes(np.stack(drawn.to_numpy()), hashes, n, perturbations(k, most_probes), recall)[0] if len(drawn) > 1 else 1
    changes = perturbations(k, probes)

    def packed(batches: Iterator[pa.RecordBatch], probing: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256 if probing else 4096) for i in range(0, len(batch), 256 if probing else 4096)):
                vectors = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)
                data = pa.array([x.tobytes() for x in vectors], pa.binary())
                for t in range(tables):
                    keys = hashes.probes(vectors, t, changes) if probing else hashes.keys(hashes.cells(vectors, t)[0])[:, None]
                    take = pa.array(np.repeat(np.arange(len(part)), keys.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(keys.size, t), pa.int32()), pa.array(keys.reshape(-1)), part.column(0).take(take), part.column(1).take(take), data.take(take)],
                        ["tbl", "bucket", "row", "id", "v"],
                    )

    shape = "tbl int, bucket long, row long, id long, v binary"
    asked = rows.filter(F.col("id") % every == 0)
    index = rows.mapInArrow(lambda b: packed(b, False), shape)
    visits = asked.mapInArrow(lambda b: packed(b, True), shape)

    def search(key: tuple, asking: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(found):
            of = lambda df: np.frombuffer(b"".join(df["v"]), dtype=np.float64).reshape(len(df), dims)
            q_rows, q_ids, c_rows, c_ids = (x.to_numpy() for x in (asking["row"], asking["id"], found["row"], found["id"]))
            out = [(q_rows[i], q_ids[i], c_rows[j], c_ids[j], d) for i, j, d in nearest_of(of(asking), q_rows, of(found), c_rows, c_ids, n)]
        return pd.DataFrame(out, columns=["query_row", "query_id", "row", "vec_id", "score"])

    def parts(index: DataFrame, visits: DataFrame) -> DataFrame:
        """Candidates of every visited bucket: the best n of each of its parts."""
        n_parts = F.ceil(F.col("count") / bucket_rows).cast("int")
        sizes = written(index.groupBy("tbl", "bucket").count().select("tbl", "bucket", n_parts.alias("n")), "buckets")
        placed = index.join(sizes, ["tbl", "bucket"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("n")).cast("int")).drop("n")
        asking = visits.join(sizes, ["tbl", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        keys = ["tbl", "bucket", "part"]
        return asking.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(
            search, "query_row long, query_id long, row long, vec_id long, score double"
        )

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id", "row"))
        return found.dropDuplicates(["query_row", "row"]).withColumn("rank", rank).filter(F.col("rank") <= n)

    found = written(best(parts(index, visits)), "found")
    enough = found.groupBy("query_row").count().filter(F.col("count") >= min(n, total - 1))
    short = written(asked.join(enough.select(F.col("query_row").alias("row")), "row", "left_anti").select("row", "id", "v"), "short")
    as_binary = F.pandas_udf(lambda vectors: vectors.map(lambda v: np.asarray(v, dtype=np.float64).tobytes()), "binary", F.PandasUDFType.SCALAR)
    everything = lambda df: df.select(
        F.lit(ALL).alias("tbl"), F.lit(0).cast("long").alias("bucket"), "row", "id", as_binary(F.col("v")).alias("v")
    )
    if not short.isEmpty():
        rest = best(parts(everything(rows), everything(short)))
        found = found.join(enough, "query_row", "left_semi").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
