"""Events: validation, routing and qualification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.sources.topics import EVENTS

# The events and actions that are routed, and the shape of ids.
ROUTED = ["pull_request", "push", "installation", "installation_repositories"]
REVIEW_ACTIONS = ["opened", "synchronize", "reopened", "ready_for_review"]
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
PAYLOAD = (
    "action string, number bigint, ref string, after string, deleted boolean, installation struct<id:bigint>, "
    "repository struct<id:bigint,full_name:string,default_branch:string>, repositories array<struct<id:bigint>>, "
    "repositories_added array<struct<id:bigint>>, pull_request struct<draft:boolean,state:string,head:struct<sha:string>>"
)


def first_reason(*rules: tuple[Column, Column | str]) -> Column:
    """The reason of the first rule that holds; null if none does."""
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), F.lit(why) if isinstance(why, str) else why) for test, why in rules))


def violations(kind: str, e: Column) -> Column:
    """The rules of an event's shape that it breaks, as an array of texts."""
    text = lambda name: (e[name].isNull() | (e[name] == ""), f"{name}: must not be empty")
    positive = lambda name: (e[name].isNull() | (e[name] <= 0), f"{name}: must be a positive integer")
    among = lambda name, values: (e[name].isNull() | ~e[name].isin(values), f"{name}: must be one of {', '.join(values)}")
    shape = lambda name, pattern, what: (e[name].isNull() | ~e[name].rlike(pattern), f"{name}: {what}")
    rules = {
        "webhook.received": [shape("webhookEventId", UUID, "must be a uuid"), text("deliveryId"), text("eventType")],
        "review.requested": [
            positive("installationId"),
            shape("repoFullName", r"^[^/\s]+/[^/\s]+$", "must be owner/name"),
            positive("prNumber"),
            shape("headSha", r"^[0-9a-f]{40}$", "must be a 40-char commit sha"),
            among("trigger", ["webhook", "manual"]),
        ],
        "repo.index.requested": [
            shape("repositoryId", UUID, "must be a uuid"),
            positive("installationId"),
            among("reason", ["installed", "push", "review", "manual"]),
        ],
    }[kind]
    return F.array_compact(F.array(*(F.when(test, F.lit(why)) for test, why in [(e["type"].isNull() | (e["type"] != kind), "type: wrong literal"), *rules])))


def parse_events(raw: DataFrame, kind: str) -> DataFrame:
    """raw with event, the parsed value, and reason, which is null where the event is valid."""
    event = F.from_json("value", EVENTS[kind])
    is_json = F.try_parse_json("value").isNotNull()
    return raw.withColumn("event", event).withColumn(
        "reason",
        F.when(~is_json, "invalid JSON").otherwise(
            F.when(F.size(violations(kind, F.col("event"))) > 0, F.concat(F.lit("schema: "), F.array_join(violations(kind, F.col("event")), "; ")))
        ),
    )


def prefilter_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin(ROUTED))


def route_reviews(events: DataFrame) -> DataFrame:
    """events(event_type, payload) with review, reason, and what a review request needs."""
    p = F.col("p")
    pr = p["pull_request"]
    missing = pr.isNull() | p["repository"].isNull() | p["installation"].isNull() | (F.coalesce(p["number"], F.lit(0)) == 0)
    missing |= F.coalesce(pr["head"]["sha"], F.lit("")) == ""
    reason = first_reason(
        (F.col("event_type") != "pull_request", F.concat(F.lit("event "), F.col("event_type"))),
        (~F.coalesce(p["action"].isin(REVIEW_ACTIONS), F.lit(False)), F.concat(F.lit("action "), F.coalesce(p["action"], F.lit("undefined")))),
        (missing, "incomplete payload"),
        (pr["draft"], "draft PR"),
        (F.coalesce(pr["state"] != "open", F.lit(True)), "PR not open"),
    )
    return (
        events.withColumn("p", F.from_json("payload", PAYLOAD))
        .withColumn("reason", reason)
        .withColumn("review", F.col("reason").isNull())
        .withColumns({
            "installation_id": F.when(F.col("review"), p["installation"]["id"]),
            "github_repo_id": F.when(F.col("review"), p["repository"]["id"]),
            "pr_number": F.when(F.col("review"), p["number"]),
            "head_sha": F.when(F.col("review"), pr["head"]["sha"]),
        })
        .drop("p")
    )


def route_index(events: DataFrame) -> DataFrame:
    """A row for each repository whose code index an event makes stale: github_repo_id, installation_id, ref, reason."""
    p = F.col("p")
    ids = lambda name: F.transform(F.coalesce(p[name], F.array().cast("array<struct<id:bigint>>")), lambda r: r["id"])
    kind, action = F.col("event_type"), p["action"]
    pushed = (
        (kind == "push") & p["repository"].isNotNull() & ~F.coalesce(p["deleted"], F.lit(False)) & (F.coalesce(p["after"], F.lit("")) != "")
        & ~p["after"].rlike("^0+$") & (p["ref"] == F.concat(F.lit("refs/heads/"), p["repository"]["default_branch"]))
    )
    repos = (
        F.when((kind == "installation") & (action == "created"), ids("repositories"))
        .when((kind == "installation_repositories") & (action == "added"), ids("repositories_added"))
        .when(pushed, F.array(p["repository"]["id"]))
    )
    return (
        events.withColumn("p", F.from_json("payload", PAYLOAD))
        .filter(p["installation"].isNotNull())
        .select(
            *events.columns,
            p["installation"]["id"].alias("installation_id"),
            F.when(kind == "push", p["after"]).alias("ref"),
            F.when(kind == "push", "push").otherwise("installed").alias("reason"),
            F.explode(repos).alias("github_repo_id"),
        )
    )


def qualify_review_requests(routes: DataFrame, repositories: DataFrame, installations: DataFrame) -> DataFrame:
    """Routed events with skip, null where a review is to be requested. An unknown installation passes."""
    repos = repositories.select(
        F.col("github_repo_id"), F.col("full_name").alias("repo_full_name"), F.col("active").alias("_active"), F.col("auto_review_enabled").alias("_auto")
    )
    status = installations.select("installation_id", F.col("status").alias("_status"))
    skip = first_reason(
        (~F.coalesce("_active", F.lit(False)), "repo not granted"),
        (~F.coalesce("_auto", F.lit(False)), "auto-review off"),
        (F.col("_status") != "active", F.concat(F.lit("installation "), F.col("_status"))),
    )
    return (
        routes.filter("review")
        .join(repos, "github_repo_id", "left")
        .join(status, "installation_id", "left")
        .withColumn("skip", skip)
        .drop("_active", "_auto", "_status")
    )


def qualify_index_requests(routes: DataFrame, repositories: DataFrame) -> DataFrame:
    repos = repositories.filter("active").select("github_repo_id", F.col("id").alias("repository_id"), "full_name")
    return routes.join(repos, "github_repo_id")


def request_missing_indexes(reviews: DataFrame, repositories: DataFrame) -> DataFrame:
    """Index requests for reviewed repositories that have no index yet."""
    repos = repositories.filter("indexed_sha is null").select(F.col("id").alias("repository_id"), F.col("full_name").alias("repo_full_name"), "installation_id")
    reviewed = reviews.select("repo_full_name").distinct()
    return reviewed.join(repos, "repo_full_name").select("repository_id", "installation_id", F.lit(None).cast("string").alias("ref"), F.lit("review").alias("reason"))
