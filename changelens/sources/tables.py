"""Stored tables with declared schemas and keys, repository listings, contents and evaluation files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "installations": "installation_id bigint, account_id bigint, account_login string, account_type string, owner_user_id string, status string, "
    "permissions map<string,string>, events array<string>, created_at timestamp",
    "repositories": "id string, github_repo_id bigint, installation_id bigint, owner string, name string, full_name string, private boolean, html_url string, "
    "language string, description string, auto_review_enabled boolean, active boolean, default_branch string, indexed_sha string, indexed_at timestamp",
    "webhook_events": "id string, delivery_id string, event_type string, action string, payload string, status string, error string, "
    "received_at timestamp, published_at timestamp",
    "reviews": "id string, installation_id bigint, repo_full_name string, pr_number int, head_sha string, base_sha string, reviewed_from_sha string, "
    "pr_title string, status string, progress string, trigger string, score int, attempts int, tokens bigint, duration_ms bigint, summary string, "
    "error string, assurance string, created_at timestamp, updated_at timestamp, completed_at timestamp",
    "review_findings": "id string, review_id string, file string, line int, severity string, category string, message string, suggestion string, "
    "source string, confidence float, status string, created_at timestamp",
    "code_files": "repository_id string, path string, blob_sha string, imports array<string>",
    "code_chunks": "id string, repository_id string, path string, symbol string, start_line int, end_line int, content string, "
    "embedding array<float>, commit_sha string",
}
KEYS = {
    "installations": ["installation_id"],
    "repositories": ["github_repo_id"],
    "webhook_events": ["delivery_id"],
    "reviews": ["repo_full_name", "pr_number", "head_sha"],
    "review_findings": ["id"],
    "code_files": ["repository_id", "path"],
    "code_chunks": ["id"],
}
EVAL_CASE = (
    "name string, description string, title string, body string, files array<struct<path:string,before:array<string>,after:array<string>>>, "
    "expected array<struct<file:string,line:int,category:string>>"
)
# Code files by extension, and vendored or generated paths.
CODE = r"(?i)\.(c|m)?(j|t)sx?$|\.(py|go|rb|java|kt|rs|php|cs|swift|scala|vue|svelte|sql|sh)$"
VENDORED = (
    r"(^|/)(node_modules|dist|build|out|coverage|vendor|\.next|\.git|__snapshots__)/|\.min\.|\.generated\."
    r"|(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock)$"
)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def write_table(df: DataFrame, path: str, name: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/{name}")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the session's checkpoint folder: computed once, whatever reads it and whichever executor is lost.

    In local mode a temporary folder stands in for an unset one; on a cluster that is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="changelens-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_code_file(path: Column) -> Column:
    return path.rlike(CODE) & ~path.rlike(VENDORED)


def scan_tree(entries: DataFrame, most: int = 1500, max_bytes: int = 200_000) -> DataFrame:
    """Code files of listings(repository_id, ord, type, path, sha, size): of each repository the first `most`."""
    kept = entries.filter(
        (F.col("type") == "blob") & F.col("path").isNotNull() & F.col("sha").isNotNull() & is_code_file(F.col("path"))
        & (F.coalesce("size", F.lit(0)) <= max_bytes)
    )
    place = F.row_number().over(Window.partitionBy("repository_id").orderBy("ord", "path"))
    return kept.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def decode_blob(content: Column, encoding: Column, max_bytes: int = 200_000) -> Column:
    """Text of a base64 or plain blob; null for binary contents, which hold a NUL, and for contents over max_bytes."""
    data = F.when(encoding == "base64", F.unbase64(F.regexp_replace(content, r"\s", ""))).otherwise(content.cast("binary"))
    text = F.decode(data, "UTF-8")
    return F.when((F.octet_length(data) <= max_bytes) & ~text.contains("\x00"), text)


def ingest_diff_files(raw: DataFrame, most: int = 300) -> DataFrame:
    """The five fields of each changed file, at most `most` a comparison, in listing order."""
    place = F.row_number().over(Window.partitionBy("review_id").orderBy("ord"))
    return (
        raw.withColumn("place", place)
        .filter(F.col("place") <= most)
        .select("review_id", "ord", "filename", "status", "additions", "deletions", "patch")
    )


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_CASE).option("multiLine", True).json(path).orderBy("name")


def write_eval_results(results: DataFrame, path: str, stamp: str) -> None:
    results.write.mode("overwrite").json(f"{path}/{stamp}")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model string, recall double, precision double, falsePositives int, errors int, tokens bigint").option("multiLine", True).json(path)


def replace_baseline(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """table with changes merged in by key, which must be unique on either side.

    rules names, for columns that aren't simply taken over, an expression over t.column (stored) and c.column
    (changed); other columns of changes win. Columns that changes lacks keep their stored value.
    """
    rules = rules or {}
    t, c = table.alias("t"), changes.withColumn("_changed", F.lit(True)).alias("c")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    on = same[0]
    for condition in same[1:]:
        on &= condition
    changed = F.coalesce("c._changed", F.lit(False))

    def column(name: str) -> Column:
        if name in keys:
            return F.coalesce(f"t.{name}", f"c.{name}").alias(name)
        if name in rules:
            return F.when(changed, rules[name]).otherwise(F.col(f"t.{name}")).alias(name)
        if name in changes.columns:
            return F.when(changed, F.col(f"c.{name}")).otherwise(F.col(f"t.{name}")).alias(name)
        return F.col(f"t.{name}").alias(name)

    return t.join(c, on, "full_outer").select(*(column(n) for n in table.columns))
