"""Merkle dataset manifest: a content-addressed tree over all rows, and inclusion proofs by descent from its root."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.scratch import named, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 8
#: Tables of up to so many runs of ranked rows, one a group and partition, are broadcast; larger ones are joined by shuffling.
BROADCAST_RUNS = 100_000
PATH = "array<struct<digit:int,siblings:array<string>>>"


def digest_of(*values: Column) -> Column:
    """Lower-case hexadecimal sha256 of the values, one behind the other."""
    return F.sha2(F.concat(*values), 256)


def sealed(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, so that neighbours can't run into each other; - for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


@dataclass
class Tree:
    """Written tables of one tree a group.

    levels[0] are the ranked leaves (grp, rank, n, digest, payload). levels[k] are the records of the nodes above
    (grp, rank, n, digest, members): a node's digest with its children's in order, which at level 1 carry the leaves'
    payloads. n counts a group's nodes at that level. roots (grp, depth, digest) has each group's last node.
    """

    levels: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None


def ranked(leaves: DataFrame, *order: str) -> DataFrame:
    """leaves(grp, digest, payload, number, *order) with rank, from 0 in each group, and n, the group's leaves.

    Rows are ranged by group and order and written sorted; a partition's rows of a group are one run, whose first rank
    is the number of rows in the runs before it. So no task sorts or counts a group, however large; number, unique,
    keeps even rows that agree in everything from sharing a partition.
    """
    keys = ["grp", *order, "digest", "number"]
    placed = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed.select("grp", "digest", "payload", "place", F.shiftright("place", 33).alias("part")), "merkle-placed")
    one = Window.partitionBy("grp")
    before = F.sum("count").over(one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(
        placed.groupBy("grp", "part")
        .agg(F.min("place").alias("first"), F.count("*").alias("count"))
        .select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("count").over(one).alias("n")),
        "merkle-runs",
    )
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    return placed.join(runs, ["grp", "part"]).select("grp", (F.col("place") + F.col("shift")).alias("rank"), "n", "digest", "payload")


def grown(leaves: DataFrame, *order: str) -> Tree:
    """The tree of each group of leaves(grp, digest, payload, number, *order): runs of FAN_OUT become a node, until one is left."""
    tree = Tree([written(ranked(leaves, *order), "merkle-leaves")])
    last = lambda depth: tree.levels[depth].filter("n = 1").select("grp", F.lit(depth).alias("depth"), "digest")
    tree.roots = last(0)
    while not tree.levels[-1].filter("n > 1").isEmpty():
        below = tree.levels[-1]
        member = F.struct("rank", "digest", *(["payload"] if "payload" in below.columns else []))
        members = F.sort_array(F.collect_list(member))
        up = F.floor(F.col("rank") / FAN_OUT).alias("rank"), F.ceil(F.col("n") / FAN_OUT).alias("n")
        nodes = below.filter("n > 1").groupBy("grp", *up).agg(members.alias("members"))
        digest = digest_of(F.array_join(F.transform("members", lambda m: m["digest"]), ""))
        tree.levels.append(written(nodes.select("grp", "rank", "n", digest.alias("digest"), "members"), f"merkle-level-{len(tree.levels)}"))
        tree.roots = tree.roots.unionByName(last(len(tree.levels) - 1))
    return tree


def descended(tree: Tree, starts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(grp, payload, digest, path) of each leaf: path has, from the root down, the leaf's digit in its run and the run's others.

    starts(grp, depth, digest, path) are roots with the path that leads to them. Descent goes level by level, from a
    digest to its record, and from there to the children; requests that share a node share its visit, so all levels
    above the leaves cost a seventh of what the leaves do. The place in the tree is part of a record's key beside its
    digest, so that equal subtrees don't gather on one key. wanted(grp, rank) names the leaves asked for, by default all;
    a child is visited if it has one of them below it.
    """
    at = None
    for depth in range(len(tree.levels) - 1, 0, -1):
        new = starts.filter(F.col("depth") == depth).select("grp", F.lit(0).cast("long").alias("rank"), "digest", "path")
        at = new if at is None else at.unionByName(new)
        found = at.join(tree.levels[depth].select("grp", "rank", "digest", "members"), ["grp", "rank", "digest"])
        others = F.transform(F.filter("members", lambda m: m["rank"] != F.col("m.rank")), lambda m: m["digest"])
        digit = (F.col("m.rank") - FAN_OUT * F.col("rank")).cast("int")
        step = F.array(F.struct(digit.alias("digit"), others.alias("siblings")))
        at = found.select("*", F.explode("members").alias("m")).select(
            "grp", F.col("m.rank").alias("rank"), F.col("m.digest").alias("digest"), F.concat("path", step).alias("path"), *(["m.payload"] if depth == 1 else [])
        )
        if wanted is not None:
            at = at.join(wanted.select("grp", F.floor(F.col("rank") / FAN_OUT ** (depth - 1)).alias("rank")).distinct(), ["grp", "rank"], "left_semi")
    alone = tree.levels[0].filter("n = 1").join(starts.filter("depth = 0").select("grp", "path"), "grp")
    if wanted is not None:
        alone = alone.join(wanted, ["grp", "rank"], "left_semi")
    alone = alone.select("grp", "payload", "digest", "path")
    return alone if at is None else at.select("grp", "payload", "digest", "path").unionByName(alone)


def folded(leaf: Column, climb: Column) -> Column:
    """The root that follows from a leaf's digest and the siblings on its way up."""

    def above(digest: Column, step: Column) -> Column:
        left, right = F.slice(step["siblings"], F.lit(1), step["digit"]), F.slice(step["siblings"], step["digit"] + 1, F.lit(FAN_OUT))
        return digest_of(F.array_join(left, ""), digest, F.array_join(right, ""))

    return F.aggregate(climb, leaf, above)


def sealed_leaves(docs: DataFrame, *, id_col: str, group_col: str, columns: tuple[str, ...], tampered: dict[str, Column] | None) -> DataFrame:
    """(grp, id, digest, payload, number) of each row, written: payload has the id and, if it differs, the digest after tampering."""
    values = {c: F.col(named(c)) for c in columns}
    own = digest_of(*(sealed(v) for v in values.values()))
    other = digest_of(*(sealed(v) for v in (values | (tampered or {})).values()))
    group = F.coalesce(F.concat(F.lit("="), F.col(named(group_col)).cast("string")), F.lit(""))  # a null group stands first, apart from an empty one
    rows = docs.select(group.alias("grp"), F.col(named(id_col)).alias("id"), own.alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("number"))
    payload = F.struct("id", F.nullif("other", "digest").alias("other"))
    return written(rows.select("grp", "id", "digest", payload.alias("payload"), "number"), "merkle-sealed")


def inclusion_proofs(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    group_col: str = "lang",
    columns: tuple[str, ...] = COLUMNS,
    tampered: dict[str, Column] | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Each row's leaf, its group's and the whole table's root, its proof, and the root that follows from it after tampering.

    A leaf is the digest of the row's columns, each with its length before it. In a group, leaves stand by id, ties by
    digest, null ids first; runs of eight become a node, the digest of their digests, until one node is left, the
    subroot. The subroots, in the order of the groups, null first, become the root in the same way. The proof is, level
    by level from the leaf to the root, the digit in each run and the digests of the run's other nodes, from left to
    right. folded_root is computed from the proof and the leaf, or, where `tampered` replaces a column's value by another
    one, the leaf of the replaced values; verified says whether it is the root.

    Returned: doc_id, grp, leaf, subroot, root, proof (an array of digit and siblings, from the leaf up), folded_root,
    verified. wanted(grp, rank) asks for some leaves only, by their group ("=" and its name, or "" for null) and rank.

    Repeated rows are leaves of their own. Null values are sealed as nulls, empty ones as empty. Texts count whole at any
    length. A group of one row has its leaf as subroot; an empty table gives an empty result. Extra columns are not
    read, whatever their names.
    """
    leaves = sealed_leaves(docs, id_col=id_col, group_col=group_col, columns=columns, tampered=tampered)
    tree = grown(leaves, "id")
    subroots = tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest", F.struct("grp", "depth").alias("payload"), F.monotonically_increasing_id().alias("number"))
    top = grown(written(subroots, "merkle-subroots"), "id")
    empty = F.array().cast(PATH).alias("path")
    down = written(descended(top, top.roots.select("*", empty)).select("payload.*", "digest", "path"), "merkle-top-paths")
    root = top.roots.first()
    starts = down.withColumns({"subroot": F.col("digest"), "root": F.lit(root and root["digest"])})  # a row a group: the way from the root to the subroot
    found = descended(tree, starts.select("grp", "depth", "digest", "path"), wanted)
    of_group = starts.select("grp", "subroot", "root")
    of_group = F.broadcast(of_group) if of_group.count() <= BROADCAST_RUNS else of_group
    climb = F.reverse("path")
    return (
        found.join(of_group, "grp")
        .select("grp", F.col("payload.id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", climb.alias("proof"), F.coalesce("payload.other", "digest").alias("used"))
        .withColumn("folded_root", folded(F.col("used"), F.col("proof")))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
        .drop("used")
    )


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest_digests(docs: DataFrame) -> DataFrame:
    """inclusion_proofs of documents, a third of whose texts is tampered with, the proofs as digests."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = {"text": F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))}
    siblings = F.array_join(F.flatten(F.transform("proof", lambda s: s["siblings"])), "")
    return inclusion_proofs(docs, tampered=changed).select(
        "doc_id", "leaf", "subroot", "root", digest_of(siblings).alias("proof_sha256"), "folded_root", "verified"
    )
