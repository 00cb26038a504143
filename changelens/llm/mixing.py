"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree deals source blocks to shards."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.quality_rules import let
from changelens.llm.scratch import named, written

WEIGHTS = (5, 2, 1)
#: Tables of up to so many sources, or of so many ranges of blocks, are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 50_000
#: Rows that a bucket of a source's random order holds on average, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 1024


def source_targets(
    sizes: list[tuple[str | None, int]], *, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0
) -> dict[str | None, float]:
    """Words wanted of each source: share of all words by weight, at most `most` times the source's own.

    Sources stand in code-point order, null last, and take the weights in turn. What lies above a source's limit
    is dealt again by weight among the others until no target is above its limit.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    size = dict(order)
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    left, open_, target = share * sum(size.values()), [name for name, _ in order], {}
    while open_:
        per_weight = left / sum(weight[name] for name in open_)
        above = [name for name in open_ if per_weight * weight[name] > most * size[name]]
        if not above:
            target |= {name: per_weight * weight[name] for name in open_}
            break
        for name in above:
            target[name] = most * size[name]
            left -= target[name]
        open_ = [name for name in open_ if name not in set(above)]
        left = max(left, 0.0)
    return target


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones are among n drawn without replacement. numpy's own draw ends at a billion; beyond, see by_weights."""
    if not n or not good:
        return 0
    if not bad:
        return n
    return int(rng.hypergeometric(good, bad, n)) if good + bad < 10**9 else by_weights(rng, good, bad, n)


def by_weights(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The same draw by its probabilities, each from its neighbour by their exact ratio, out to 12 standard deviations
    from the most frequent number, beyond which less than double precision lies."""
    p = good / (good + bad)
    spread = math.sqrt(n * p * (1 - p) * (good + bad - n) / (good + bad - 1))
    least, most = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), least), most)
    low, high = max(least, mode - int(12 * spread) - 2), min(most, mode + int(12 * spread) + 2)
    k = np.arange(low, high, dtype=np.float64)  # from k to k + 1
    steps = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(logs - logs[mode - low]))
    return low + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def split_quotas(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each colour (column) for each shard (row), by halving the shards again and again.

    Each halving draws the left half's blocks from its node's blocks without replacement, one multivariate
    hypergeometric draw, so every shard gets an equal number of blocks (to one) and all quotas are met exactly.
    """
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)
    total = int(sum(quotas))
    edge = [total * i // n_shards for i in range(n_shards + 1)]

    def draw(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
        taken, rest = np.zeros_like(colors), int(colors.sum())
        for i, c in enumerate(colors.tolist()):
            rest -= c
            taken[i] = hypergeometric(rng, c, rest, n)
            n -= int(taken[i])
        return taken

    nodes = [(0, n_shards, np.array(quotas, dtype=np.int64))]
    while nodes:
        low, high, colors = nodes.pop()
        if high - low == 1:
            out[low] = colors
            continue
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = draw(rng, colors, edge[middle] - edge[low])
        nodes += [(low, middle, left), (middle, high, colors - left)]
    return out


def mix_blocks(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    n_shards: int = 64,
    block_words: int = 512,
    seed: int = 17,
    row_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks): every input row with its source's target, and the blocks that the shards draw of it.

    A document is cut into blocks of block_words, the last shorter. A source's pool holds its blocks in one or more
    passes, as often as its target covers it: all but the last pass are used up; the last one's quota is the number of
    its blocks, in a random order, that reach what is left of the target, and the last of them is cut to meet it to a
    word. split_quotas deals the block quotas of all (source, pass) pairs to the shards. Each shard draws its counts as
    the next, disjoint runs of each pass's permuted blocks; shuffle_key is the order inside a shard. The permutation
    is keyed by the seed alone: what is drawn doesn't hang on the number of shards, only where it lies does.

    row_id is row_col, a long that numbers the rows, or a number given here.

    rows: row_id, doc_id, source, size, source_size, target. blocks: row_id, doc_id, source, size, copy, block, start,
    words, shard, shuffle_key. A null or empty text has size 0 and gives no block; a null source is a source of its
    own; repeated rows each count; an empty table gives empty results. Reruns agree: the order hangs on doc_id, size
    and seed. The driver holds one row a source and pass, and their counts for each shard.

    A pass's order lies in buckets of a hash, about BUCKET_ROWS blocks each, so no task sorts a source.
    """
    spark = docs.sparkSession
    words = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]++"))
    rows = written(
        docs.select(
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(words, F.lit(0)).cast("long").alias("size"),
        ),
        "mix-rows",
    )
    of_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.sum(F.ceil(F.col("size") / block_words)).alias("n")).collect()
    sizes = [(r["source"], r["size"]) for r in of_source]
    target = source_targets(sizes, share=share)
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df

    def plan_row(name: str | None, size: int) -> tuple:
        quota = min(round(target[name]), 2 * size)
        copies = quota // size if size else 0
        return name, size, float(target[name]), copies, quota - copies * size

    plan = spark.createDataFrame([plan_row(*x) for x in sizes], "s string, source_size long, target double, copies long, remainder long")
    rows = rows.join(small(plan, len(sizes)), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bits = max(LEAST_BUCKETS, max((r["n"] for r in of_source), default=0) // BUCKET_ROWS).bit_length()

    copies = F.sequence(F.lit(0).cast("long"), F.col("copies") - F.when(F.col("remainder") > 0, 0).otherwise(1))
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_words).cast("long"))
    pool = (
        rows.filter("size > 0 and copies + remainder > 0")
        .withColumn("copy", F.explode(copies))
        .withColumn("wanted", F.when(F.col("copy") == F.col("copies"), F.col("remainder")))  # of the last pass
        .select("row_id", "doc_id", "source", "size", "copy", "wanted", F.posexplode(starts).alias("block", "start"))
        .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("start")))
        .withColumn("place", F.xxhash64("doc_id", "size", "copy", "block", F.lit(seed)))
        .withColumn("bucket", F.shiftrightunsigned("place", 64 - bits))
    )
    one_pass = Window.partitionBy("source", "copy").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = (
        pool.groupBy("source", "copy", "bucket")
        .agg(F.count("*").alias("n"), F.sum("words").alias("w"))
        .select(
            F.col("source").alias("s"), F.col("copy").alias("c"), F.col("bucket").alias("b"),
            F.coalesce(F.sum("n").over(one_pass), zero).alias("blocks_before"), F.coalesce(F.sum("w").over(one_pass), zero).alias("words_before"),
        )
    )
    inside = Window.partitionBy("source", "copy", "bucket").orderBy("place", "doc_id", "size", "block", "row_id")
    at = F.col("source").eqNullSafe(F.col("s")) & (F.col("copy") == F.col("c")) & (F.col("bucket") == F.col("b"))
    before = F.col("words_before") + F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero)
    drawn = written(
        pool.join(offsets, at)
        .withColumn("rank", F.col("blocks_before") + F.row_number().over(inside) - 1)
        .withColumn("left", F.col("wanted") - before)
        .filter("left is null or left > 0")
        .withColumn("words", F.least("words", F.coalesce("left", "words")))
        .select("row_id", "doc_id", "source", "size", "copy", "block", "start", "words", "rank", "place"),
        "mix-drawn",
    )
    quotas = {(r["source"], r["copy"]): r["count"] for r in drawn.groupBy("source", "copy").count().collect()}
    names = sorted(quotas, key=lambda x: (x[0] is None, x[0] or "", x[1]))
    dealt = split_quotas([quotas[x] for x in names], n_shards, seed)
    return rows.drop("copies", "remainder"), drawn_by_shard(drawn, names, dealt, seed, small)


def drawn_by_shard(drawn: DataFrame, names: list[tuple], dealt: np.ndarray, seed: int, small) -> DataFrame:
    """Each shard's draw: of a pass's permuted blocks, drawn(source, copy, rank, ...), the run that the shard's count gives it.

    Runs and blocks meet by (source, copy) and cell, a cell being as many ranks as a shard has on average, so a run
    touches few cells and a block is compared with the runs in its cell only.
    """
    n_shards = len(dealt)
    cell = {name: max(1, int(dealt[:, i].sum()) // n_shards) for i, name in enumerate(names)}
    runs = []
    for i, name in enumerate(names):
        ends = np.cumsum(dealt[:, i]).tolist()
        for shard, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            runs += [(*name, c, shard, low, high) for c in range(low // cell[name], (high - 1) // cell[name] + 1) if high > low]
    run_rows = drawn.sparkSession.createDataFrame(runs, "s string, c long, run_cell long, shard int, low long, high long")
    cells = drawn.sparkSession.createDataFrame([(*name, n) for name, n in cell.items()], "s string, c long, cell long")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("copy") == F.col("c"))
    placed = drawn.join(small(cells, len(cell)), same).withColumn("at_cell", F.floor(F.col("rank") / F.col("cell"))).drop("s", "c", "cell")
    return (
        placed.join(small(run_rows, len(runs)), same & (F.col("at_cell") == F.col("run_cell")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select("row_id", "doc_id", "source", "size", "copy", "block", "start", "words", "shard", F.xxhash64("place", F.lit(seed + 2)).alias("shuffle_key"))
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """One row per document: what the shards draw of it. See mix_blocks for nulls, ties and repeats.

    shard and shuffle_key are those of its first block: of the smallest copy, then of the smallest start.
    """
    rows, blocks = mix_blocks(docs, **options)
    first = F.min(F.struct("copy", "block", "shard", "shuffle_key"))
    taken = blocks.groupBy("row_id").agg(
        F.sum("words").alias("words"), F.count("*").alias("n_blocks"), F.countDistinct("shard").alias("n_shards"), first.alias("first")
    )
    zero = F.lit(0).cast("long")
    return rows.join(taken, "row_id", "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.coalesce("words", zero).alias("taken"),
        F.coalesce("n_blocks", zero).alias("n_blocks"),
        F.coalesce("n_shards", zero).alias("n_shards"),
        F.col("first.shard").alias("shard"),
        F.col("first.shuffle_key").alias("shuffle_key"),
    )


def laid_out(rows: DataFrame, n_shards: int, shard: Column, shuffle_key: Column, parts: int = 1) -> DataFrame:
    """rows shard by shard, each in its own random order, for a writer to keep.

    A shard lies in `parts` neighbouring partitions, which hold equal ranges of its random shuffle_key in order, so
    a large shard is no single task's.
    """
    part = F.least(F.floor((shuffle_key.cast("double") / 2.0**64 + 0.5) * parts).cast("int"), F.lit(parts - 1))
    return rows.repartitionById(n_shards * parts, shard * parts + part).sortWithinPartitions(shard, shuffle_key)


#: A list of drawn copies of up to so many bytes is broadcast to the documents; a larger one is joined by shuffling.
BROADCAST_BYTES = 32 << 20


def mixed_documents(
    docs: DataFrame, *, text_col: str = "text", n_shards: int = 64, block_words: int = 512, part_words: int = 16 << 20, **options
) -> DataFrame:
    """docs as the shards draw them: a row for each copy of which a block is drawn, shard by shard in shuffled order.

    A copy whose blocks are all drawn keeps its text; another holds the words of its drawn blocks, in the text's order,
    each with the blanks and line ends that follow it there. It lies in the shard of its first drawn block, at that
    block's place; a shard is laid out in partitions of about part_words words. Documents are numbered in a written
    table and read from its struct, so that a copy finds its row by number and no column's name can clash.
    Documents of no words, which no mix counts, are left out. Nulls, repeats and empty tables are as in mix_blocks.
    """
    columns = [F.col(named(c)) for c in docs.columns]
    stored = written(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*columns).alias("document")), "mix-documents")
    of = {key: options.pop(key, default) for key, default in (("id_col", "doc_id"), ("source_col", "source"))}
    field = lambda name: F.col("document")[name]
    flat = stored.select("number", field(of["id_col"]).alias("doc_id"), field(text_col).alias("text"), field(of["source_col"]).alias("source"))
    _, blocks = mix_blocks(flat, row_col="number", n_shards=n_shards, block_words=block_words, **options)
    part = F.struct("start", "words", "shard", "shuffle_key")
    copies = written(
        blocks.groupBy("row_id", "copy", "size")
        .agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(part)).alias("parts"))
        .select(
            "row_id", "words", F.col("parts")[0]["shard"].alias("shard"), F.col("parts")[0]["shuffle_key"].alias("shuffle_key"),
            F.when(F.col("words") < F.col("size"), F.transform("parts", lambda p: F.struct(p["start"].alias("start"), p["words"].alias("words")))).alias("parts"),
        ),
        "mix-copies",
    )
    held, words = copies.agg(F.sum(64 + 48 * F.coalesce(F.size("parts"), F.lit(0))), F.sum("words")).first()
    if (held or 0) <= BROADCAST_BYTES:
        copies = F.broadcast(copies)
    text = field(text_col)
    split = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"), F.lit(0))
    pieces = let(split, lambda w: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(w, p["start"].cast("int") + 1, p["words"].cast("int")))), ""))
    cut = F.when(F.col("parts").isNull(), text).otherwise(pieces)
    drawn = stored.join(copies, F.col("number") == F.col("row_id")).select("document", cut.alias("mixed_text"), "shard", "shuffle_key")
    parts = max(1, -(-(words or 0) // (n_shards * part_words)))
    return laid_out(drawn, n_shards, F.col("shard"), F.col("shuffle_key"), parts).select(
        *(F.col("mixed_text").alias(c) if c == text_col else field(c).alias(c) for c in docs.columns)
    )
