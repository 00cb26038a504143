"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.components import UnionFind, components
from changelens.llm.scratch import named, ship, written
from changelens.llm.signatures import band_keys, set_digest, shingle_set, super_minhash

#: Up to so many nodes, texts are picked by a broadcast list of them; beyond, by a shuffled join.
BROADCAST_NODES = 200_000
#: Pairs that share a band are confirmed on their sets, whatever else their signatures say. Other pairs of a family, which
#: banding doesn't propose, are confirmed too if their signatures agree on this share.
ESTIMATE = 0.55
#: Rows in the order in which one is elected; null ids count as largest.
SMALLEST = "struct(doc_id IS NULL, doc_id, text_hash, number)"


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, over sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def link_forest(nodes: np.ndarray, signatures: np.ndarray, texts: list[str], percent: int, band_rows: int = 4) -> list[tuple[int, int]]:
    """(node, root) for each node that is linked with another, however indirectly, among these texts.

    Every pair that shares a band is confirmed on whole sets, unless a chain of links joins it already.
    """
    n, slots = signatures.shape
    bands = signatures.reshape(n, slots // band_rows, band_rows)
    sets = [shingle_set(t) for t in texts]
    size = np.array([len(s) for s in sets])
    found, root = UnionFind(), np.arange(n)
    step = max(1, (1 << 24) // (n * slots))
    for first in range(0, n, step):
        part = slice(first, min(first + step, n))
        equal = signatures[part, None, :] == signatures[None, :, :]
        same = np.count_nonzero(equal, axis=2)
        banded = equal.reshape(*equal.shape[:2], *bands.shape[1:]).all(axis=3).any(axis=2)
        small, large = np.minimum(size[part, None], size[None, :]), np.maximum(size[part, None], size[None, :])
        wanted = (banded | (same >= ESTIMATE * slots)) & (100 * small >= percent * large) & (root[part, None] != root[None, :])
        i, j = np.nonzero(wanted)
        i += first
        later = i < j
        i, j = i[later], j[later]
        likely = np.argsort(-same[i - first, j], kind="stable")
        for a, b in zip(i[likely].tolist(), j[likely].tolist(), strict=True):
            if found.find(a) != found.find(b) and linked(sets[a], sets[b], percent):
                found.union(a, b)
        root = np.array([found.find(x) for x in range(n)])
    return [(int(nodes[x]), int(nodes[r])) for x, r in enumerate(root.tolist()) if x != r]


def signed(docs: DataFrame, id_col: str, text_col: str, number_col: str | None, slots: int, band_rows: int) -> DataFrame:
    """Each row's number, set size and name, its bands' keys and one byte of each signature slot; nulls where the set is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_shingles", "set_id", "bands", "signature")}
            for text in batch.column(2):
                shingles = shingle_set(text.as_py())
                row = [len(shingles), None, None, None]
                if len(shingles):
                    signature = super_minhash(shingles, slots)
                    bytes_ = (signature * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)
                    row[1:] = set_digest(shingles), band_keys(signature, band_rows).view(np.int64), bytes_.tobytes()
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))],
                ["doc_id", "text_hash", "number", *out],
            )

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    number = (F.col(number_col) if number_col else F.lit(None)).cast("long").alias("number")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), number).mapInArrow(
        sign, f"doc_id {kind}, text_hash long, number long, n_shingles long, set_id binary, bands array<long>, signature binary"
    )


def grouped_nodes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    number_col: str | None = None,
    percent: int = 75,
    slots: int = 128,
    band_rows: int = 4,
    family_bytes: int = 64 << 20,
    block_bytes: int = 8 << 20,
    block_rows: int = 128,
    spread: int = 24,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, groups): the rows as signed() gives them; a node for each shingle set, with the doc_id, text_hash and
    number of its smallest row; and the component of each node that is linked with another. See near_duplicates.
    """
    rows = written(signed(docs, id_col, text_col, number_col, slots, band_rows), "signed")
    nodes = written(
        rows.filter("n_shingles > 0")
        .groupBy("set_id")
        .agg(
            F.min(F.expr(SMALLEST)).alias("first"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("signature").alias("signature"),
        )
        .select(
            F.monotonically_increasing_id().alias("node"), "set_id", "n_shingles", "bands", "signature", "first.doc_id", "first.text_hash", "first.number"
        ),
        "nodes",
    )
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    shared = written(keyed.join(buckets.select("key", "least"), "key"), "shared")
    families = components(shared.filter("node != least").select("node", "least").distinct(), "node", "least")
    member = families.join(nodes.select("node", "n_shingles", "signature", "doc_id", "text_hash"), "node")
    member = written(member.withColumn("bytes", F.col("n_shingles") * 8 + slots), "members")
    size = (F.sum("bytes").alias("unit_bytes"), F.count("*").alias("unit_rows"))
    whole = member.join(member.groupBy("component").agg(*size), "component").select("node", "bytes", F.col("component").alias("unit"), "unit_bytes", "unit_rows")
    loose = shared.select("node", F.col("key").alias("unit")).join(
        whole.filter(F.col("unit_bytes") > family_bytes).select("node", "bytes"), "node"
    )
    loose = loose.join(loose.groupBy("unit").agg(*size), "unit").select("node", "bytes", "unit", "unit_bytes", "unit_rows")
    total = member.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    by_rows = F.least(F.lit(spread), F.ceil(F.col("unit_rows") / block_rows))
    n_blocks = F.greatest(F.ceil(F.col("unit_bytes") / block_bytes), by_rows).cast("int")
    lanes = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    block = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j"))))
    lane = F.pmod(F.xxhash64("unit"), F.lit(lanes))
    tasks = (
        whole.filter(F.col("unit_bytes") <= family_bytes)
        .union(loose)
        .withColumn("pair", pair)
        .select("node", "unit", "pair", F.when(n_blocks == 1, lane).otherwise(F.xxhash64("unit", "pair")).alias("task"))
    )
    wanted = member.select("node", "signature", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    if member.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")))
        .select("node", "signature", "text")
        .dropDuplicates(["node"]),
        "family-texts",
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in group.groupby(["unit", "i", "j"]):
            found = np.frombuffer(b"".join(unit["signature"]), dtype=np.uint8).reshape(len(unit), -1)
            out += link_forest(unit["node"].to_numpy(), found, unit["text"].tolist(), percent, band_rows)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    forest = (
        tasks.join(texts, "node")
        .select("task", "unit", "pair.i", "pair.j", "node", "signature", "text")
        .groupBy("task")
        .applyInPandas(compare, "a long, b long")
    )
    return rows, nodes, components(forest)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id and kept.

    Rows of equal shingle sets form one node. A node gets a SuperMinHash signature, cut into bands of band_rows; nodes
    that share a band's key are candidates. With 32 bands of 4, two nodes of similarity 0.75 share none about five
    times in a million. Candidates' components are families. A family's members are compared inside tasks: all pairs that
    share a band, and others whose signatures are close, are confirmed on their whole sets, and a task returns a forest,
    never its pairs. Families of over block_bytes, or of over block_rows members, which make up to `spread` blocks, are cut
    into blocks and each pair of blocks meets in one task, so no task holds more than about twice block_bytes and a
    family's pairs are spread over many tasks. If a family exceeds family_bytes, its buckets take its place, cut the same
    way, so that a chain of loose candidates doesn't become one large comparison. The forests' components are the
    result; component_id is the smallest doc_id in it.

    Null, empty and blank texts have an empty set and stand alone, component_id being their own doc_id. Repeated rows
    share a node and are all kept or not by their doc_id. Null ids count as largest. Texts are whole at any length. An
    empty table gives an empty result. Only id_col and text_col are read.
    """
    rows, nodes, groups = grouped_nodes(docs, **options)
    ids = nodes.select("node", "doc_id").join(groups, "node")
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    node_ids = groups.join(least, "component").select("node", "component_id")
    named = (
        nodes.select("set_id", "node", F.col("doc_id").alias("own_id"))
        .join(node_ids, "node", "left")
        .select("set_id", F.coalesce("component_id", "own_id").alias("component_id"))
    )
    return (
        rows.select("doc_id", "n_shingles", "set_id")
        .join(named, "set_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component, that of its smallest id; every row whose set is empty stays.

    Rows are numbered in a written table, elected and dropped by number, so repeated and null ids are documents of their
    own. Of rows of the smallest id, the one of the smallest text hash and number stays. Up to BROADCAST_NODES dropped
    numbers are broadcast; more are joined by shuffling.
    """
    columns = [F.col(named(c)) for c in docs.columns]
    stored = written(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*columns).alias("document")), "dedup-documents")
    flat = stored.select("number", F.col("document")[id_col].alias("doc_id"), F.col("document")[text_col].alias("text"))
    rows, nodes, groups = grouped_nodes(flat, number_col="number", **options)
    group = F.coalesce("component", "node").alias("group")
    elected = nodes.join(groups, "node", "left").groupBy(group).agg(F.min(F.expr(SMALLEST))["number"].alias("number"))
    drop = written(rows.filter("n_shingles > 0").select("number").join(elected.select("number"), "number", "left_anti"), "dropped")
    if drop.count() <= BROADCAST_NODES:
        drop = F.broadcast(drop)
    return stored.join(drop, "number", "left_anti").select("document.*")
