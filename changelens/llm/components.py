"""Connected components of an edge table, by union-find in tasks and star contractions between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.scratch import ship, written


class UnionFind:
    """Sets of hashable, ordered items; a set's root is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (above := self.parent.setdefault(root, root)) != root:
            root = above
        while (above := self.parent[x]) != root:
            self.parent[x], x = root, above
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


#: Nodes that a task's union-find holds before it hands on what it has found.
NODES_IN_TASK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as (node, root) of the forest that they make in this task."""
    sets = UnionFind()

    def rows() -> pa.RecordBatch:
        pairs = [(x, r) for x in sets.parent if (r := sets.find(x)) != x]
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets.parent) > NODES_IN_TASK:
            yield rows()
            sets = UnionFind()
    yield rows()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it reaches. Nodes are longs.

    Each round first shrinks the edges, in each task, to a forest by union-find. Then every node points all its
    neighbours to the smallest one: first its larger neighbours (large star), then itself and its smaller ones (small
    star). Edges become stars around the components' smallest nodes in a number of rounds that grows with the
    logarithm of the paths' lengths; each round is a table in shared storage, so a lost executor costs one round at
    most. A node's neighbours are only aggregated and joined, never collected. Edges with a null end and loops are
    left out; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    ship(spark)
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a != b")
    current = written(ends.mapInArrow(_forest, "a long, b long"), "forest")
    while True:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The minima are tables of their own, so that a join with them is one of two plain inputs, which adaptive
        # execution broadcasts or splits: a star's centre has all its edges under one key.
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        large = written(large, "large-star")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = (
            large.join(low, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .filter("a != b")
            .distinct()
        )
        after = written(small, "small-star")
        # Stars: nobody is both a leaf and a centre, and a leaf has one centre.
        leaves = after.select("a")
        done = (
            after.join(leaves.withColumnRenamed("a", "b").distinct(), "b", "left_semi").isEmpty()
            and leaves.groupBy("a").count().filter("count > 1").isEmpty()
        )
        current = after
        if done:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
