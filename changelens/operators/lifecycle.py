"""Review life cycles: claims, requests, progress, recovery and what was reviewed before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["repo_full_name", "pr_number", "head_sha"]


def claim_reviews(requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """requests(KEY, seq) with claimed: the first of each key, if its review is new, pending or failed."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq")) == 1
    stored = reviews.select(*KEY, F.col("status").alias("_status"))
    free = F.coalesce(F.col("_status").isin("pending", "failed"), F.lit(True))
    return requests.withColumn("_first", first).join(stored, KEY, "left").withColumn("claimed", F.col("_first") & free).drop("_first", "_status")


def request_manual(requests: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new pending reviews, requests to publish) of requests(KEY, seq): a key that is running or done is not asked for again.

    Of several requests for a key, the first by seq counts; without seq, by the other columns.
    """
    order = ["seq"] if "seq" in requests.columns else requests.columns
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    asked = requests.withColumn("_first", first).filter("_first = 1").drop("_first")
    stored = reviews.select(*KEY, F.col("status").alias("_status"))
    joined = asked.join(stored, KEY, "left")
    new = joined.filter("_status is null").drop("_status").withColumn("status", F.lit("pending"))
    publish = joined.filter("_status is null or _status not in ('in_progress', 'completed')").drop("_status")
    return new, publish


def publish_failed(pending: DataFrame, errors: DataFrame) -> DataFrame:
    """pending reviews with those whose request could not be published, errors(KEY, error), failed with their error."""
    why = errors.groupBy(*KEY).agg(F.min("error").alias("_error"))
    joined = pending.join(why, KEY, "left")
    return joined.withColumns({
        "status": F.when(F.col("_error").isNull(), F.col("status")).otherwise("failed"), "error": F.substring("_error", 1, 1000),
    }).drop("_error")


def lifecycle(updates: DataFrame) -> DataFrame:
    """Each review's state after updates(review_id, seq, at, progress, status, error, score).

    The latest update's progress and status hold, other columns keep their last value that wasn't null; an end clears
    progress and sets completed_at and duration_ms.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    state = updates.groupBy("review_id").agg(
        last("status"), last("progress"), last("error"), last("score"), F.max("at").alias("updated_at"), F.min("at").alias("started_at")
    )
    ended = F.col("status").isin("completed", "failed")
    return state.withColumns({
        "progress": F.when(~F.coalesce(ended, F.lit(False)), F.col("progress")),
        "error": F.substring("error", 1, 1000),
        "completed_at": F.when(ended, F.col("updated_at")),
        "duration_ms": F.when(ended, F.unix_millis(F.col("updated_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))),
    })


def sweep_stuck(reviews: DataFrame, now: str, minutes: int = 10, most: int = 20, attempts: int = 3) -> DataFrame:
    """What becomes of reviews that stand still: failed after too many attempts, else, up to `most`, requeued."""
    idle = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))
    stuck = reviews.filter(F.col("status").isin("pending", "in_progress") & (idle > minutes * 60))
    failed = stuck.filter(F.col("attempts") >= attempts).withColumns({
        "new_status": F.lit("failed"), "new_error": F.lit(f"Timed out after {attempts} attempts"), "new_attempts": F.col("attempts"),
    })
    again = (
        stuck.filter((F.col("attempts") < attempts) & F.col("installation_id").isNotNull())
        .orderBy("updated_at", "id")
        .limit(most)
        .withColumns({"new_status": F.lit("pending"), "new_error": F.lit(None).cast("string"), "new_attempts": F.col("attempts") + 1})
    )
    return failed.unionByName(again)


def sweep_outbox(events: DataFrame, now: str, seconds: int = 30, most: int = 50) -> DataFrame:
    """Received events that have waited too long, the oldest `most`, to be published again."""
    waited = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("received_at").cast("timestamp"))
    return events.filter((F.col("status") == "received") & (waited > seconds)).orderBy("received_at", "event_id").limit(most)


def sweep_results(picked: DataFrame, errors: DataFrame, now: str) -> DataFrame:
    """What becomes of the events of sweep_outbox: sent in order up to the first error, which is noted; the rest stay received.

    errors(event_id, error) of sending. Out come the picked rows with outcome (sent, failed, untouched), new_status,
    new_error and published_at. picked are as few as the sweep takes, so one window orders them all.
    """
    noted = errors.groupBy("event_id").agg(F.min("error").alias("_error"), F.lit(True).alias("_bad"))
    order = Window.orderBy("received_at", "event_id")
    bad = F.coalesce("_bad", F.lit(False))
    failing = F.min(F.when(bad, F.col("_place"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outcome = F.when(F.col("_failing").isNull(), "sent").when(F.col("_failing") == F.col("_place"), "failed").otherwise("untouched")
    sent, failed = F.col("outcome") == "sent", F.col("outcome") == "failed"
    return (
        picked.join(F.broadcast(noted), "event_id", "left")
        .withColumn("_place", F.row_number().over(order))
        .withColumn("_failing", failing)
        .withColumn("outcome", outcome)
        .withColumns({
            "new_status": F.when(sent, "published").otherwise(F.col("status")),
            "new_error": F.when(failed, F.substring(F.concat(F.lit("sweeper: "), F.coalesce("_error", F.lit(""))), 1, 500)),
            "published_at": F.when(sent, F.lit(now).cast("timestamp")),
        })
        .drop("_error", "_bad", "_place", "_failing")
    )


def ingest_events(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """events with duplicate: the first of a delivery id, by (received_at, event_id), wins for ever."""
    later = F.row_number().over(Window.partitionBy("delivery_id").orderBy("received_at", "event_id")) > 1
    out = events.withColumn("duplicate", later)
    if stored is None:
        return out
    known = stored.select("delivery_id").distinct().withColumn("_known", F.lit(True))
    return out.join(known, "delivery_id", "left").withColumn("duplicate", F.col("duplicate") | F.coalesce("_known", F.lit(False))).drop("_known")


def mark_published(events: DataFrame, sent: DataFrame) -> DataFrame:
    """events with those of sent(delivery_id, sent_at) published; all others keep their state."""
    s = sent.groupBy("delivery_id").agg(F.min("sent_at").alias("_sent_at"))
    return (
        events.join(s, "delivery_id", "left")
        .withColumn("status", F.when((F.col("status") == "received") & F.col("_sent_at").isNotNull(), "published").otherwise(F.col("status")))
        .withColumnRenamed("_sent_at", "published_at")
    )


def progress_changes(updates: DataFrame) -> DataFrame:
    """updates(review_id, seq, status, progress) where status or progress is new; done on an end, nothing behind it."""
    w = Window.partitionBy("review_id").orderBy("seq")
    state = F.concat_ws(":", F.coalesce("status", F.lit("")), F.coalesce("progress", F.lit("")))
    ended = F.col("status").isin("completed", "failed")
    before = F.coalesce(F.max(ended.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        updates.withColumn("_state", state)
        .withColumn("_changed", ~F.col("_state").eqNullSafe(F.lag("_state").over(w)))
        .withColumn("_over", before == 1)
        .filter("_changed and not _over")
        .withColumn("done", F.coalesce(ended, F.lit(False)))
        .drop("_state", "_changed", "_over")
    )


def previous_review(requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """requests(repo_full_name, pr_number, head_sha) with previous_sha, the head of the newest other completed review."""
    done = reviews.filter("status = 'completed'").select("repo_full_name", "pr_number", F.col("head_sha").alias("previous_sha"), F.col("completed_at").alias("_at"), F.col("id").alias("_id"))
    joined = requests.join(done, ["repo_full_name", "pr_number"], "left")
    other = F.col("previous_sha") != F.col("head_sha")
    return joined.groupBy(*KEY).agg(F.max_by("previous_sha", F.when(other, F.struct("_at", "_id"))).alias("previous_sha"))


def diff_base(requests: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """requests(base_sha, previous_sha) with from_sha: the previous head unless it is null or missing(previous_sha)."""
    if missing is None:
        return requests.withColumn("from_sha", F.coalesce("previous_sha", "base_sha"))
    gone = missing.select("previous_sha").distinct().withColumn("_gone", F.lit(True))
    kept = F.when(F.col("_gone").isNull(), F.col("previous_sha"))
    return requests.join(gone, "previous_sha", "left").withColumn("from_sha", F.coalesce(kept, "base_sha")).drop("_gone")


def latest_review_per_pr(pulls: DataFrame, reviews: DataFrame) -> DataFrame:
    """pulls(repo_full_name, pr_number, pr_head_sha) with their newest review and whether it is outdated."""
    newest = reviews.groupBy("repo_full_name", "pr_number").agg(
        F.max_by(F.struct("id", "head_sha", "status", "score"), F.struct("created_at", "id")).alias("r")
    )
    return pulls.join(newest, ["repo_full_name", "pr_number"], "left").select(
        *pulls.columns, F.col("r.id").alias("review_id"), "r.status", "r.score", (F.col("r.head_sha") != F.col("pr_head_sha")).alias("outdated")
    )


def reviewed_pull_count(pulls: DataFrame) -> DataFrame:
    """Over latest_review_per_pr: pulls whose newest review is complete and of their head, by repository."""
    return pulls.groupBy("repo_full_name").agg(F.count_if((F.col("status") == "completed") & ~F.col("outdated")).alias("reviewed"))


def save_findings(stored: DataFrame, results: DataFrame) -> DataFrame:
    """stored with all findings of the reviews in results replaced by theirs."""
    done = results.select("review_id").distinct()
    return stored.join(done, "review_id", "left_anti").unionByName(results.select(*stored.columns))


def set_finding_status(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """findings with the latest of changes(review_id, id, seq, status) applied; a finding must belong to the review."""
    known = changes.filter(F.col("status").isin("open", "resolved", "dismissed"))
    last = known.groupBy("review_id", "id").agg(F.max_by("status", "seq").alias("_status"))
    return findings.join(last, ["review_id", "id"], "left").withColumn("status", F.coalesce("_status", "status")).select(*findings.columns)


def set_auto_review(repositories: DataFrame, changes: DataFrame) -> DataFrame:
    """repositories with the latest of changes(github_repo_id, seq, enabled) applied."""
    last = changes.groupBy("github_repo_id").agg(F.max_by("enabled", "seq").alias("_enabled"))
    return repositories.join(last, "github_repo_id", "left").withColumn("auto_review_enabled", F.coalesce("_enabled", "auto_review_enabled")).select(*repositories.columns)


def repost_findings(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings to post again, with the commit that the diff starts from."""
    ready = reviews.filter("status = 'completed' and score is not null and installation_id is not null")
    ready = ready.select(F.col("id").alias("review_id"), F.coalesce("reviewed_from_sha", "base_sha").alias("from_sha")).filter("from_sha is not null")
    return findings.filter("status <> 'dismissed'").join(ready, "review_id")
