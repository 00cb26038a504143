"""Two-phase retrieval against all pairs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from changelens.operators import retrieval


def plain(queries, chunks, changed, k, limit):
    out = []
    for review, repo, v in queries:
        near = []
        for r, i, path, w in chunks:
            if r is None or r != repo or v is None or w is None or len(v) != len(w) or None in v or None in w or (review, path) in changed or not any(v) or not any(w):
                continue
            d = 1 - sum(a * b for a, b in zip(v, w, strict=True)) / (math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(b * b for b in w)))
            if d < limit:
                near.append((d, i, path))
        out += [(review, i, path, place + 1) for place, (d, i, path) in enumerate(sorted(near)[:k])]
    return sorted(out)


def test_top_k_equals_all_pairs_in_small_parts(spark):
    rng = random.Random(2)
    # Components are small whole numbers, so that distances tie exactly.
    vector = lambda dims=4: [float(rng.randrange(-2, 3)) for _ in range(dims)]
    chunks = [("hot" if i % 3 else f"r{i % 5}", i, f"p{i % 17}", vector()) for i in range(400)]
    chunks += [("hot", 900, "p1", None), ("hot", 901, "p1", [0.0] * 4), ("hot", 902, "p1", [1.0, None, 0.0, 0.0]), ("hot", 903, "p1", vector(3)), (None, 904, "p1", vector())]
    queries = [(i, "hot" if i % 2 else f"r{i % 5}", vector()) for i in range(60)] + [(70, "none", vector()), (71, "hot", None), (72, "hot", vector(3)), (73, "hot", [0.0] * 4)]
    changed = {(i, f"p{(i * 7 + j) % 17}") for i in range(50) for j in range(3)}
    frames = (
        spark.createDataFrame(queries, "review_id long, repository_id string, embedding array<float>"),
        spark.createDataFrame(chunks, "repository_id string, id long, path string, embedding array<float>"),
        spark.createDataFrame(sorted(changed), "review_id long, path string"),
    )
    for part_rows, asking_rows in ((37, 5), (4096, 512)):
        out = retrieval.rag_top_k(*frames, k=5, max_distance=0.7, part_rows=part_rows, asking_rows=asking_rows)
        assert sorted((r["review_id"], r["id"], r["path"], r["place"]) for r in out.collect()) == plain(queries, chunks, changed, 5, 0.7)
    assert retrieval.rag_top_k(frames[0], frames[1].limit(0)).count() == 0 and retrieval.rag_top_k(frames[0].limit(0), frames[1], frames[2]).count() == 0


def test_blocks_are_bounded_however_large_a_repository(spark):
    chunks = spark.range(3000).select(F.lit("hot").alias("repository_id"), "id", F.lit("p").alias("path"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"))
    queries = chunks.filter("id < 40").select(F.col("id").alias("review_id"), "repository_id", "embedding")
    out = retrieval.rag_top_k(queries, chunks, k=8, max_distance=2.1, part_rows=250, asking_rows=20)
    # Every part keeps its own best, so what is merged are k rows a query and part.
    assert out.groupBy("review_id").count().filter("count = 8").count() == 40
    assert out.filter("place = 1 and id = review_id").count() == 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_a_block_keeps_ties_and_hides_places():
    asked, held = np.array([[1.0, 0.0]]), np.array([[1.0, 0.0], [2.0, 0.0], [3.0, 0.0], [0.0, 1.0]])
    ((_, places, distances),) = retrieval.nearest_in_block(asked, held, 1, 0.5, [np.array([1])])
    assert places.tolist() == [0, 2] and distances.tolist() == [0.0, 0.0]
