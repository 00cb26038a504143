"""Sharding: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.scratch import written


def lpt_assign(items: list[tuple[str, int]], n_shards: int) -> dict[str, int]:
    """Largest first, each to the least-loaded shard; ties go to the smaller name and the smaller shard."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for name, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def lpt_shards(
    docs: DataFrame,
    n_shards: int = 40,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_overhead: int = 16,
    grain: int = 256,
    lanes: int = 64,
) -> DataFrame:
    """Every row gets a shard and a slot; rows of equal text share a shard; shard bytes come out nearly equal.

    Groups above 1/(n_shards * grain) of all bytes, at most n_shards * grain of them, are scheduled one by one.
    Smaller groups are first put, whole, into n_shards * grain bundles by a hash, and the bundles are scheduled
    with the large groups on one heap. So the driver sees at most 2 * n_shards * grain items at any input size,
    and a shard is off the mean by about one bundle.

    Null text has no bytes, a null checksum, and forms one group apart from the empty text. Repeated rows each
    keep a slot. An empty input gives an empty result. Only id_col and text_col are read, so further columns of
    any name don't matter. Slots run from 0 without gaps in each shard.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + row_overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit("null")).alias("text_group"),
        ),
        "lpt-rows",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    limit = total // (n_shards * grain)
    bundle = F.concat(F.lit("bundle-"), F.pmod(F.xxhash64("text_group"), F.lit(n_shards * grain)).cast("string"))
    items = (
        rows.groupBy("text_group")
        .agg(F.sum("size").alias("size"))
        .groupBy(F.when(F.col("size") > limit, F.col("text_group")).otherwise(bundle).alias("item"))
        .agg(F.sum("size").alias("size"))
    )
    placed = lpt_assign([(r["item"], r["size"]) for r in items.collect()], n_shards)

    def plan(name: str, whole: bool) -> DataFrame:
        found = [(k, v) for k, v in placed.items() if k.startswith("bundle-") != whole]
        return F.broadcast(spark.createDataFrame(found, f"{name} string, {name}_shard int"))

    placed_rows = (
        rows.withColumn("bundle", bundle)
        .join(plan("text_group", True), "text_group", "left")
        .join(plan("bundle", False), "bundle", "left")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "text_group",
            F.coalesce("text_group_shard", "bundle_shard").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "text_group"), F.lit(lanes)).cast("int").alias("lane"),
        )
    )
    # A slot is its lane's offset in the shard plus the place in the lane, so that no task sorts a whole shard.
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed_rows.groupBy("shard", "lane")
        .count()
        .select("shard", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    place = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_group")) - 1
    return placed_rows.join(F.broadcast(offsets), ["shard", "lane"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + place).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
