"""Diffs: lines, line sets, numbered text, and packing under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.paths import skipped_path


def classify_diff_files(files: DataFrame) -> DataFrame:
    """files(status, patch, filename) with reviewable and the reason where it isn't."""
    bare = F.coalesce("patch", F.lit("")) == ""
    reason = F.when(F.col("status") == "removed", "deleted").when(bare, "binary or too large").when(skipped_path(F.col("filename")), "generated/vendored")
    return files.withColumn("reason", reason).withColumn("reviewable", F.col("reason").isNull())


def parse_patch(files: DataFrame, *keys: str) -> DataFrame:
    """files(keys, patch) as lines(keys, i, kind, new_line, text).

    A hunk header sets the number that the next line has in the new file; added and context lines count on, removed
    ones have no number. Lines before the first header and those that begin with a backslash are left out. The sums
    run inside one file's rows.
    """
    raw = files.filter("patch is not null").select(*keys, F.posexplode(F.split("patch", "\n", -1)).alias("i", "line"))
    header = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    file = Window.partitionBy(*keys).orderBy("i")
    hunk = Window.partitionBy(*keys, "hunk").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.col("kind").isin("+", " ").cast("int")
    return (
        raw.withColumn("start", F.when(header != "", header.cast("int")))
        .withColumn("hunk", F.count("start").over(file))
        .withColumn("from", F.last("start", ignorenulls=True).over(file))
        .filter("hunk > 0 and start is null and not startswith(line, '\\\\')")
        .withColumn("kind", F.when(F.substring("line", 1, 1).isin("+", "-"), F.substring("line", 1, 1)).otherwise(" "))
        .withColumn("new_line", F.when(F.col("kind") != "-", F.col("from") + F.coalesce(F.sum(counts).over(hunk), F.lit(0))).cast("int"))
        .select(*keys, "i", "kind", "new_line", F.expr("substring(line, 2)").alias("text"))
    )


def commentable_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("kind").isin("+", " "))


def added_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("kind = '+'")


def number_patch(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, numbered): each line as its kind, its number in five places, and its text."""
    number = F.coalesce(F.lpad(F.col("new_line").cast("string"), 5, " "), F.lit("     "))
    row = F.concat("kind", number, F.lit(" | "), "text")
    ordered = F.sort_array(F.collect_list(F.struct("i", row.alias("row"))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["row"]), "\n").alias("numbered"))


def pack_diff(files: DataFrame, budget: int = 12_000, key: str = "review_id") -> DataFrame:
    """(key, text, included, skipped) of files(key, ord, filename, status, patch): the smallest first, while they fit.

    A file that doesn't fit is skipped and the next one tried. Key and ord name one file. The fit is decided on sizes
    alone: a review's files that aren't above the budget by themselves are folded as (size, ord, filename, tokens), and
    only texts that fit, which the budget bounds, are numbered and gathered.
    """
    judged = classify_diff_files(files)
    head = F.concat(F.lit('<file path="'), "filename", F.lit('" status="'), "status", F.lit('">\n'))
    block = F.concat(head, F.coalesce("numbered", F.lit("")), F.lit("\n</file>"))
    lines = parse_patch(judged.filter("reviewable"), key, "ord")
    # as number_patch writes them: kind, five places, bar, text and line end
    length = lines.groupBy(key, "ord").agg((F.sum(F.length("text") + 10) - 1).alias("numbered_length"))
    block_length = F.length(head) + F.coalesce("numbered_length", F.lit(0)) + F.length(F.lit("\n</file>"))
    sized = judged.join(length, [key, "ord"], "left").select(
        key,
        "ord",
        "filename",
        F.length("patch").alias("size"),
        F.when(F.col("reviewable"), F.ceil(block_length / 4)).alias("tokens"),
        "reason",
    )
    fold = sized.filter(F.col("tokens") <= budget).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("size", "ord", "filename", "tokens"))).alias("candidates"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(fold.schema["candidates"].dataType).alias("taken"))

    def add(a, f):
        fits = a["used"] + f["tokens"] <= budget
        return F.when(fits, F.struct((a["used"] + f["tokens"]).alias("used"), F.concat(a["taken"], F.array(f)).alias("taken"))).otherwise(a)

    taken = fold.select(key, F.posexplode(F.aggregate("candidates", start, add)["taken"]).alias("place", "f")).select(
        F.col(key).alias("_key"), F.col("f.ord").alias("_ord"), "place"
    )
    at = F.col(key).eqNullSafe(F.col("_key")) & F.col("ord").eqNullSafe(F.col("_ord"))
    chosen = judged.filter("reviewable").join(taken, at).drop("_key", "_ord")
    numbered = number_patch(parse_patch(chosen, key, "ord"), key, "ord")
    shown = chosen.join(numbered, [key, "ord"], "left").groupBy(F.col(key).alias("_key")).agg(
        F.sort_array(F.collect_list(F.struct("place", "filename", block.alias("block")))).alias("shown")
    )
    over = F.lit("over the token budget")
    skip = F.when(F.col("tokens").isNull(), F.struct(F.lit(0).alias("late"), F.lit(0).alias("size"), "ord", "filename", "reason")).when(
        F.col("place").isNull(), F.struct(F.lit(1).alias("late"), "size", "ord", "filename", over.alias("reason"))
    )
    listed = sized.join(taken, at, "left").groupBy(key).agg(F.sort_array(F.collect_list(skip)).alias("skipped"))
    part = lambda name: F.coalesce(F.transform("shown", lambda x: x[name]), F.array().cast("array<string>"))
    return listed.join(shown, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key,
        F.array_join(part("block"), "\n\n").alias("text"),
        part("filename").alias("included"),
        F.transform("skipped", lambda x: F.struct(x["filename"].alias("filename"), x["reason"].alias("reason"))).alias("skipped"),
    )


def line_churn(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, removed, added): how often each line text left and came between two versions(keys, text)."""
    lines = lambda df, sign: df.select(*keys, F.explode(F.split("text", "\n", -1)).alias("line"), F.lit(sign).alias("n"))
    change = lines(before, -1).unionByName(lines(after, 1)).groupBy(*keys, "line").agg(F.sum("n").alias("n")).filter("n <> 0")
    zero = F.lit(0).cast("long")
    return change.select(*keys, "line", F.greatest(-F.col("n"), zero).alias("removed"), F.greatest(F.col("n"), zero).alias("added"))


def head_content_files(files: DataFrame, most: int = 30) -> DataFrame:
    """The first files of each review whose new contents are wanted."""
    place = F.row_number().over(Window.partitionBy("review_id").orderBy("ord"))
    return files.filter("status <> 'removed' and patch is not null").withColumn("place", place).filter(F.col("place") <= most)
