"""Reports: searches, groups, trends, breakdowns, counts and pages over reviews and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.text import clean_permissions, score_band, ui_score
from changelens.operators.findings import SEVERITIES, severity_rank


def like_pattern(q: str) -> str:
    for special in ("\\", "%", "_"):
        q = q.replace(special, f"\\{special}")
    return f"%{q}%"


def search_reviews(reviews: DataFrame, q: str | None) -> DataFrame:
    """Reviews whose title or repository has q, in any case, or whose number it is, with or without '#'."""
    q = (q or "").strip()
    if not q:
        return reviews
    pattern = like_pattern(q)
    found = F.coalesce(F.col("pr_title").ilike(pattern), F.lit(False)) | F.col("repo_full_name").ilike(pattern)
    number = q.removeprefix("#")
    if number.isdigit():
        found |= F.col("pr_number") == int(number)
    return reviews.filter(found)


def search_repositories(repositories: DataFrame, q: str | None = None, tab: str = "all") -> DataFrame:
    out = repositories.filter("active")
    if (q or "").strip():
        out = out.filter(F.lower("full_name").like(like_pattern(q.strip().lower())))
    return out.filter("auto_review_enabled") if tab == "enabled" else out


def repository_counts(repositories: DataFrame, q: str | None = None) -> DataFrame:
    """All and enabled repositories; they follow the search, not the tab."""
    return search_repositories(repositories, q).agg(F.count("*").alias("all"), F.count_if("auto_review_enabled").alias("enabled"))


def review_group(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """reviews with group: working, failed, attention or completed, by three-valued logic.

    A completed review with no score and no serious open finding is in no group.
    """
    serious = findings.filter("status = 'open' and severity in ('critical', 'high')").select(F.col("review_id").alias("id")).distinct().withColumn("_open", F.lit(True))
    done = F.col("status") == "completed"
    attention = done & ((F.col("score") < 70) | F.coalesce("_open", F.lit(False)))
    group = (
        F.when(F.col("status").isin("pending", "in_progress"), "working")
        .when(F.col("status") == "failed", "failed")
        .when(attention, "attention")
        .when(done & ~attention, "completed")
    )
    return reviews.join(serious, "id", "left").withColumn("group", group).drop("_open")


def review_row(reviews: DataFrame) -> DataFrame:
    title = F.coalesce("pr_title", F.concat("repo_full_name", F.lit("#"), F.col("pr_number").cast("string")))
    url = [c for c in ("review_url", "pr_url") if c in reviews.columns]
    return reviews.withColumns({
        "title": title,
        "shown_score": ui_score(F.col("score")),
        "band": score_band(F.col("score")),
        "github_url": F.coalesce(*url) if url else F.lit(None).cast("string"),
    })


def review_detail(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Each review's row with its findings, nested in order of age."""
    issue = F.struct("ord", "id", "file", "line", "severity", "category", "message", "status")
    nested = findings.groupBy(F.col("review_id").alias("id")).agg(F.sort_array(F.collect_list(issue)).alias("issues"))
    return review_row(reviews).join(nested, "id", "left").withColumn("issues", F.coalesce("issues", F.array().cast(nested.schema["issues"].dataType)))


def repository_row(repositories: DataFrame) -> DataFrame:
    return repositories.withColumns({
        "account": F.substring_index("full_name", "/", 1),
        "html_url": F.coalesce("html_url", F.concat(F.lit("https://github.com/"), "full_name")),
    })


def installation_row(raw: DataFrame) -> DataFrame:
    """raw(installation_id, login, slug, account_id, type, suspended_at, permissions, events) as a stored row."""
    account = F.coalesce("login", "slug", F.col("account_id").cast("string"))
    return raw.select(
        "installation_id", account.alias("account_login"), F.coalesce("type", F.lit("Enterprise")).alias("account_type"),
        F.when(F.col("suspended_at").isNotNull(), "suspended").otherwise("active").alias("status"), clean_permissions(F.col("permissions")).alias("permissions"), "events",
    )


def score_trend(reviews: DataFrame, since: str | None = None, *by: str) -> DataFrame:
    """(day, avg_score, reviews): completed reviews of each day, apart for each value of the columns `by`; decimals keep halves exact."""
    kept = reviews.filter("status = 'completed'")
    if since:
        kept = kept.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    average = F.sum(F.col("score").cast("decimal(18,6)")) / F.nullif(F.count("score"), F.lit(0)) / 10
    return kept.groupBy(*by, F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.round(average, 1).cast("double").alias("avg_score"), F.count("*").alias("reviews")
    )


def category_breakdown(reviews: DataFrame, findings: DataFrame, since: str | None = None) -> DataFrame:
    """(category, severity, n) of findings that aren't dismissed, in reviews of any status since then."""
    kept = reviews.filter(F.col("created_at") >= F.lit(since).cast("timestamp")) if since else reviews
    ids = kept.select(F.col("id").alias("review_id"))
    return findings.filter("status <> 'dismissed'").join(ids, "review_id").groupBy("category", "severity").agg(F.count("*").alias("n"))


def page_total(df: DataFrame, page: int, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("has_more", F.lit(page * size) < F.col("total"))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 15, most: int = 50) -> DataFrame:
    """Rows of one page; number and size are held to what is allowed."""
    size = min(max(size, 1), most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def severity_badges(findings: DataFrame) -> DataFrame:
    """(review_id, critical, high, medium, low, major) of findings that aren't dismissed."""
    counts = findings.filter("status <> 'dismissed'").groupBy("review_id").pivot("severity", SEVERITIES).count()
    counts = counts.select("review_id", *(F.coalesce(s, F.lit(0)).alias(s) for s in SEVERITIES))
    return counts.withColumn("major", F.col("critical") + F.col("high"))


def daily_series(trend: DataFrame, last_day: str, days: int = 30) -> DataFrame:
    """One row for each of the days up to last_day; missing ones have 0 reviews."""
    end = F.lit(last_day).cast("date")
    span = trend.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("_day"))
    return span.select(F.date_format("_day", "yyyy-MM-dd").alias("day")).join(trend, "day", "left").select("day", F.coalesce("reviews", F.lit(0)).alias("reviews"), "avg_score")


def dashboard_kpis(trend: DataFrame, breakdown: DataFrame) -> DataFrame:
    """One row: reviews, their mean score weighted by count, issues, blocking ones, and each severity's."""
    scored = F.col("avg_score").isNotNull()
    weighted = F.sum(F.when(scored, F.col("avg_score").cast("decimal(10,1)") * F.col("reviews"))) / F.sum(F.when(scored, F.col("reviews")))
    left = trend.agg(F.coalesce(F.sum("reviews"), F.lit(0)).alias("reviews"), F.round(weighted, 3).cast("double").alias("avg_score"))
    right = breakdown.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("issues"),
        F.coalesce(F.sum(F.when(F.col("severity").isin("critical", "high"), F.col("n"))), F.lit(0)).alias("blocking"),
        *(F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s) for s in SEVERITIES),
    )
    return left.join(right, F.lit(True))


def open_counts(findings: DataFrame) -> DataFrame:
    """(review_id, one count for each severity, blocking) of open findings; unknown severities count as low."""
    rank = severity_rank(F.col("severity"))
    return (
        findings.filter("status not in ('resolved', 'dismissed')")
        .groupBy("review_id")
        .agg(*(F.count_if(rank == i).alias(s) for i, s in enumerate(SEVERITIES)), F.count_if(rank < 2).alias("blocking"))
    )


def issues_by_file(findings: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    """(review_id, file, worst, n, ids, place): each file's issues by severity and line; files worst first, then by size."""
    kept = findings
    for name, value in (("severity", severity), ("category", category)):
        kept = kept.filter(F.col(name) == value) if value else kept
    issue = F.struct(severity_rank(F.col("severity")).alias("rank"), F.coalesce("line", F.lit(0)).alias("line"), "id")
    grouped = kept.groupBy("review_id", "file").agg(
        F.min(severity_rank(F.col("severity"))).alias("worst"), F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(issue)), lambda x: x["id"]).alias("ids")
    )
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy("review_id").orderBy("worst", F.desc("n"), F.asc_nulls_first("file"))))


def finding_list(findings: DataFrame) -> DataFrame:
    """findings with place: those of each review by age, which their order stands for where they have no date."""
    age = "created_at" if "created_at" in findings.columns else "ord"
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("review_id").orderBy(age, "id")))


def prioritise_sensitive(chunks: DataFrame, flag: Column) -> DataFrame:
    """place: chunks of flagged paths first, each part in its old order."""
    return chunks.withColumn("new_place", F.row_number().over(Window.partitionBy("review_id").orderBy(F.desc(flag), "place")))
