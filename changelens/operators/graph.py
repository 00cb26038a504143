"""Import graph: reverse edges, fan-in, what a change can affect, and who calls it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.text import line_context


def reverse_edges(code_files: DataFrame) -> DataFrame:
    """(repository_id, path, importer), each pair once."""
    return code_files.select("repository_id", F.col("path").alias("importer"), F.explode(F.array_distinct("imports")).alias("path")).select(
        "repository_id", "path", "importer"
    )


def fan_in(code_files: DataFrame) -> DataFrame:
    return reverse_edges(code_files).groupBy("repository_id", "path").agg(F.count("*").alias("fan_in"))


def max_fan_in(changed: DataFrame, code_files: DataFrame) -> DataFrame:
    """(review_id, max_fan_in) over changed(review_id, repository_id, path); 0 where nobody imports them."""
    joined = changed.join(fan_in(code_files), ["repository_id", "path"], "left")
    return joined.groupBy("review_id").agg(F.max(F.coalesce("fan_in", F.lit(0))).alias("max_fan_in"))


def reached(changed: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """(review_id, repository_id, path, distance, origin) of files that reach a changed one by imports, by the shortest way.

    changed(review_id, repository_id, rank, path); edges as reverse_edges gives them. origin is the rank of the changed file
    at the other end; among several, the smallest. A level takes the files seen so far a step on: those of the level before
    go to their importers, and all that import anything stay by an edge to themselves. A file keeps its first distance, so
    cycles end. Thus each level reads the one before once, and nothing has to be written in between. The rows of a
    review come out together. Edges are merged, not broadcast: the size of a file tells little of what its lists unfold to.
    """
    keys = ["review_id", "repository_id", "path"]
    itself = edges.select("repository_id", F.col("importer").alias("path"), "importer").distinct()
    steps = edges.unionByName(itself).hint("merge")
    seen = changed.groupBy(*keys).agg(F.min("rank").alias("origin")).withColumn("distance", F.lit(0))
    for level in range(1, max_depth + 1):
        stays = F.col("importer") == F.col("path")
        walked = (
            seen.join(steps, ["repository_id", "path"])
            .filter((F.col("distance") == level - 1) | stays)
            .select("review_id", "repository_id", F.col("importer").alias("path"), "origin", F.when(stays, F.col("distance")).otherwise(level).alias("distance"))
        )
        new = F.col("distance") == level
        seen = (
            (walked.repartition("review_id") if level == max_depth else walked)
            .groupBy(*keys)
            .agg(F.min("distance").alias("distance"), F.min(F.when(~new, F.col("origin"))).alias("before"), F.min(F.when(new, F.col("origin"))).alias("now"))
            .select(*keys, F.when(new, F.col("now")).otherwise(F.col("before")).alias("origin"), "distance")
        )
    return seen.filter("distance > 0").select(*keys, "distance", "origin")


def blast_radius(changed: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """(review_id, path, distance, via): what changed files reach, with via, the path of the changed file at the other end.

    A review's changed files, of which there are 300 at most, meet its rows as one map, so those needn't be dealt anew by origin.
    """
    names = changed.filter("rank is not null").repartition("review_id").groupBy("review_id", "rank").agg(F.min("path").alias("path"))
    names = names.groupBy("review_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "path"))).alias("names")).hint("merge")
    found = reached(changed, edges, max_depth).filter("origin is not null").join(names, "review_id")
    return found.select("review_id", "path", "distance", F.element_at("names", F.col("origin")).alias("via"))


def order_affected(affected: DataFrame) -> DataFrame:
    """affected with place: in each review the nearest first, then by path as a person would sort it."""
    return affected.withColumn("place", F.row_number().over(Window.partitionBy("review_id").orderBy("distance", F.collate("path", "UNICODE"), "path")))


def nearest_caller_files(affected: DataFrame, most: int = 10) -> DataFrame:
    """The first files of each review that import a changed file."""
    return order_affected(affected.filter("distance = 1")).filter(F.col("place") <= most)


def find_callers(symbols: DataFrame, files: DataFrame, radius: int = 5, most: int = 12) -> DataFrame:
    """(review_id, symbol, path, line, snippet) where files(review_id, ord, path, content) use symbols(review_id, symbol).

    A line's first name before '(', '<' or '.' that is a changed symbol is a hit, but not in import, re-export and
    comment lines. Names are joined with symbols by equality. After a hit the next radius lines of the file are passed
    over; each review keeps its first `most` hits in file order.
    """
    lines = files.select("review_id", "ord", "path", F.posexplode(F.split("content", "\n", -1)).alias("i", "line")).filter(
        ~F.col("line").rlike(r"^\s*(import|export\s+\{|//|\*)")
    )
    names = F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_$][\w$]*)\s*[(<.]"))
    used = lines.select("review_id", "ord", "path", "i", F.posexplode(names).alias("at", "symbol"))
    hits = (
        used.join(symbols.select("review_id", "symbol").distinct(), ["review_id", "symbol"])
        .groupBy("review_id", "ord", "path", "i")
        .agg(F.min_by("symbol", "at").alias("symbol"))
    )
    step = lambda kept, h: F.when((F.size(kept) == 0) | (h["i"] > F.element_at(kept, -1)["i"] + radius), F.concat(kept, F.array(h))).otherwise(kept)
    listed = hits.groupBy("review_id", "ord", "path").agg(F.sort_array(F.collect_list(F.struct("i", "symbol"))).alias("hits"))
    none = F.array().cast("array<struct<i:int,symbol:string>>")
    apart = listed.select("review_id", "ord", "path", F.explode(F.aggregate("hits", none, step)).alias("h"))
    place = F.row_number().over(Window.partitionBy("review_id").orderBy("ord", "path", "h.i"))
    kept = apart.withColumn("place", place).filter(F.col("place") <= most)
    line = (F.col("h.i") + 1).cast("int")
    return kept.join(files.select("review_id", "ord", "path", "content"), ["review_id", "ord", "path"]).select(
        "review_id", "place", F.col("h.symbol").alias("symbol"), "path", line.alias("line"), line_context(F.col("content"), line, radius).alias("snippet")
    )
