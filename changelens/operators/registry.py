"""Registry: installations, repositories, and who sees what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible_repositories(installations: DataFrame, repositories: DataFrame) -> DataFrame:
    """(user, repo_full_name) over installations that aren't deleted; inactive repositories stay visible."""
    owned = installations.filter("status <> 'deleted' and owner_user_id is not null").select("installation_id", F.col("owner_user_id").alias("user"))
    return owned.join(repositories.select("installation_id", F.col("full_name").alias("repo_full_name")), "installation_id").select("user", "repo_full_name").distinct()


def scope_reviews(reviews: DataFrame, visible: DataFrame) -> DataFrame:
    """The reviews of each user's visible repositories; a review seen by two users comes twice."""
    return reviews.join(visible, "repo_full_name")


def accessible_repository(requests: DataFrame, installations: DataFrame, repositories: DataFrame) -> DataFrame:
    """requests(user, name) with the active repository of that name, in any case, of the user's active installation."""
    repos = repositories.filter("active").select("github_repo_id", "full_name", "installation_id", F.lower("full_name").alias("_name"))
    owned = installations.filter("status = 'active'").select("installation_id", F.col("owner_user_id").alias("_user"))
    return (
        requests.withColumn("_name", F.lower("name"))
        .join(repos, "_name")
        .join(owned, "installation_id")
        .filter(F.col("user") == F.col("_user"))
        .drop("_name", "_user")
    )


def user_installations(installations: DataFrame) -> DataFrame:
    """Each user's installations that aren't deleted, by age, with whether the user has an active one."""
    by_user = Window.partitionBy("owner_user_id")
    return (
        installations.filter("owner_user_id is not null and status <> 'deleted'")
        .withColumn("place", F.row_number().over(by_user.orderBy("created_at", "installation_id")))
        .withColumn("has_active", F.bool_or(F.col("status") == "active").over(by_user))
    )


def deactivate_missing(repositories: DataFrame, granted: DataFrame) -> DataFrame:
    """repositories with those of a synced installation that it no longer grants set inactive.

    granted(installation_id, github_repo_id): one row a repository; an installation is synced if it is there at all.
    """
    synced = granted.select("installation_id").distinct().withColumn("_synced", F.lit(True))
    kept = granted.select("installation_id", "github_repo_id").distinct().withColumn("_kept", F.lit(True))
    gone = F.coalesce("_synced", F.lit(False)) & F.col("_kept").isNull()
    return (
        repositories.join(synced, "installation_id", "left")
        .join(kept, ["installation_id", "github_repo_id"], "left")
        .withColumn("active", F.col("active") & ~gone)
        .select(*repositories.columns)
    )


def deactivate_repositories(repositories: DataFrame, removed: DataFrame) -> DataFrame:
    gone = removed.select("github_repo_id").distinct().withColumn("_gone", F.lit(True))
    return (
        repositories.join(gone, "github_repo_id", "left")
        .withColumn("active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("active")))
        .select(*repositories.columns)
    )


def status_of(action: Column, suspended_at: Column | None = None) -> Column:
    """deleted and suspended by what happened; else by suspended_at, as the event's installation tells it."""
    out = F.when(action == "deleted", "deleted").when(action == "suspend", "suspended")
    if suspended_at is not None:
        out = out.when(suspended_at.isNotNull() & (action != "unsuspend"), "suspended")
    return out.otherwise("active")


def registry_installations(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Installations after events(installation_id, at, seq, action, account_login, owner_user_id), suspended_at being optional.

    The latest event's state holds, whatever order events arrive in; the owner is the first ever set. stored, with the
    same columns but action, and status, counts as older than all events.
    """
    state = events.select("installation_id", F.lit(1).alias("_age"), "at", "seq", status_of(F.col("action"), F.col("suspended_at") if "suspended_at" in events.columns else None).alias("status"), "account_login", "owner_user_id")
    if stored is not None:
        old = stored.select("installation_id", F.lit(0).alias("_age"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("seq"), "status", "account_login", "owner_user_id")
        state = state.unionByName(old)
    order = F.struct("_age", "at", "seq")
    return state.groupBy("installation_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("account_login", order).alias("account_login"),
        F.min_by("owner_user_id", F.when(F.col("owner_user_id").isNotNull(), order)).alias("owner_user_id"),
    )


def deleted_installations(repositories: DataFrame, installations: DataFrame) -> DataFrame:
    """repositories with those of deleted installations set inactive; past reviews stay, and a new install brings them back."""
    gone = installations.filter("status = 'deleted'").select("installation_id").distinct().withColumn("_gone", F.lit(True))
    return (
        repositories.join(gone, "installation_id", "left")
        .withColumn("active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("active")))
        .select(*repositories.columns)
    )


def registry_repositories(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Repositories after events(github_repo_id, installation_id, at, seq, full_name, private, html_url, language, description, removed).

    The latest event names the repository and its installation; url, language and description keep the last value that
    wasn't null. Deduced: owner and name from full_name, active unless the last event removed it. stored, with the same
    columns but at, seq and removed, and with active and auto_review_enabled, counts as older than all events. The
    user's switch auto_review_enabled is what is stored, true for new repositories: no event undoes it.
    """
    columns = ["installation_id", "full_name", "private", "html_url", "language", "description"]
    switch = F.lit(None).cast("boolean").alias("auto_review_enabled")
    state = events.select("github_repo_id", *columns, F.col("removed").alias("_gone"), F.lit(1).alias("_age"), "at", "seq", switch)
    if stored is not None:
        at, seq = (F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("at", "seq"))
        state = state.unionByName(stored.select("github_repo_id", *columns, (~F.col("active")).alias("_gone"), F.lit(0).alias("_age"), at, seq, "auto_review_enabled"))
    order = F.struct("_age", "at", "seq")
    last = lambda c: F.max_by(c, order).alias(c)
    last_known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return (
        state.groupBy("github_repo_id")
        .agg(*map(last, columns[:3]), *map(last_known, columns[3:]), last_known("auto_review_enabled"), (~F.max_by("_gone", order)).alias("active"))
        .withColumns({
            "owner": F.substring_index("full_name", "/", 1),
            "name": F.substring_index("full_name", "/", -1),
            "html_url": F.coalesce("html_url", F.concat(F.lit("https://github.com/"), "full_name")),
            "auto_review_enabled": F.coalesce("auto_review_enabled", F.lit(True)),
        })
    )


def claim_owner(installations: DataFrame, owned_accounts: DataFrame) -> DataFrame:
    """installations with an owner where there was none and an account matches: owned_accounts(user, account), lower-case logins."""
    claim = owned_accounts.groupBy(F.lower("account").alias("_account")).agg(F.min("user").alias("_user"))
    return (
        installations.withColumn("_account", F.lower("account_login"))
        .join(claim, "_account", "left")
        .withColumn("owner_user_id", F.coalesce("owner_user_id", "_user"))
        .select(*installations.columns)
    )
