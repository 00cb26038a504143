"""Retrieval: embeddings by a caller's function, and the nearest chunks of a repository."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.sources.tables import settled

Embedder = Callable[[list[str]], list[list[float]]]


def hashed_words(dims: int = 384) -> Embedder:
    """A deterministic embedder: signed counts of hashed words, of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * dims
            for word in text.lower().split():
                code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                vector[code % dims] += 1.0 if code >> 63 else -1.0
            norm = sum(x * x for x in vector) ** 0.5
            out.append([x / norm for x in vector] if norm else vector)
        return out

    return embed


def embed(df: DataFrame, embedder: Embedder | None = None, *, text_col: str = "text", dims: int = 384, batch: int = 32) -> DataFrame:
    """df with embedding, the caller's function over batches of texts; a vector of another length is an error."""
    function = embedder or hashed_words(dims)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, vectors = rows[text_col].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                vectors += function(texts[i : i + batch])
            if any(len(v) != dims for v in vectors):
                raise ValueError(f"an embedding doesn't have {dims} dimensions")
            yield rows.assign(embedding=vectors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, embedding array<float>")


#: Chunks and queries of a repository that meet in one task.
PART_ROWS, ASKING_ROWS = 4096, 512


def _by_value():
    """The search of a block as a function that travels to workers itself, so that they need no copy of this package."""

    def nearest(asked: np.ndarray, held: np.ndarray, k: int, max_distance: float, hidden: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, chunks' places, distances) below max_distance, the k nearest and all that tie with the last of them.

        One product of the block measures everything; what comes near the k-th is measured again pair by pair. hidden
        are the places that each query must not see.
        """
        norms = np.sqrt((asked**2).sum(1)), np.sqrt((held**2).sum(1))
        about = 1 - (asked @ held.T) / np.outer(*norms)
        out = []
        for i, row in enumerate(about):
            row[hidden[i]] = np.inf
            edge = max_distance + 1e-9
            if len(row) > k:
                edge = min(edge, np.partition(row, k - 1)[k - 1] + 1e-9)
            near = np.flatnonzero(row <= edge)
            exact = 1 - (held[near] * asked[i]).sum(1) / (norms[0][i] * norms[1][near])
            below = exact < max_distance
            out.append((i, near[below], exact[below]))
        return out

    return nearest


nearest_in_block = _by_value()


def rag_top_k(
    queries: DataFrame, chunks: DataFrame, changed: DataFrame | None = None, *, k: int = 8, max_distance: float = 0.6, part_rows: int = PART_ROWS, asking_rows: int = ASKING_ROWS
) -> DataFrame:
    """(review_id, id, path, distance, place): each query's nearest chunks of its repository, outside the changed paths.

    In two phases. A repository's chunks are dealt by hash to parts of about part_rows, its queries to blocks of about
    asking_rows; each part and block meet in one task as one matrix product, which keeps k a query. The parts' best are
    merged. So no task sees a whole repository, and what is shuffled between the phases are k rows a query and part.
    Ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite components take no part; vectors of
    different lengths don't meet. changed(review_id, path): few a review; they travel with its queries.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = lambda df: df.filter(F.col("repository_id").isNotNull() & F.coalesce(whole, F.lit(False))).withColumn("dims", F.size("embedding"))
    held = usable(chunks.select("repository_id", "id", "path", "embedding"))
    asked = usable(queries.select("review_id", "repository_id", "embedding"))
    if changed is not None:
        asked = asked.join(changed.groupBy("review_id").agg(F.collect_set("path").alias("hidden")), "review_id", "left")
    else:
        asked = asked.withColumn("hidden", F.array().cast("array<string>"))
    meet = ["repository_id", "dims"]
    count = lambda df, rows, name: df.groupBy(*meet).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    n = settled(count(held, part_rows, "parts").join(count(asked, asking_rows, "blocks"), meet), "retrieval-parts")
    deal = lambda key, name: F.pmod(F.xxhash64(key), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    # Row hashes, not keys alone, so that repeated ids are dealt apart as well.
    held = held.join(n, meet).withColumn("part", deal(F.struct("id", "path", F.monotonically_increasing_id()), "parts")).withColumn("block", every("blocks"))
    asked = asked.join(n, meet).withColumn("block", deal(F.struct("review_id", F.monotonically_increasing_id()), "blocks")).withColumn("part", every("parts"))

    def search(asking: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(found):
            matrix = lambda vectors: np.stack(vectors.to_numpy()).astype(np.float64)
            at = found.groupby("path").indices
            none = np.zeros(0, dtype=np.int64)
            hidden = [np.concatenate([at.get(p, none) for p in paths]) if paths is not None and len(paths) else none for paths in asking["q_hidden"]]
            review, ids, paths = asking["q_review_id"].to_numpy(), found["id"].to_numpy(), found["path"].to_numpy()
            for i, places, distances in nearest_in_block(matrix(asking["q_embedding"]), matrix(found["embedding"]), k, max_distance, hidden):
                out += zip([review[i]] * len(places), ids[places], paths[places], distances, strict=True)
        return pd.DataFrame(out, columns=["review_id", "id", "path", "distance"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"review_id {kind(queries, 'review_id')}, id {kind(chunks, 'id')}, path string, distance double"
    keys = [*meet, "part", "block"]
    # Both sides may come from one table, so the queries' columns get names of their own.
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in (*keys, "review_id", "embedding", "hidden")))
    near = asked.groupBy(*(f"q_{c}" for c in keys)).cogroup(held.groupBy(*keys)).applyInPandas(search, schema)
    place = F.row_number().over(Window.partitionBy("review_id").orderBy("distance", "id"))
    return near.withColumn("place", place).filter(F.col("place") <= k)
