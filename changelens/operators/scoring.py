"""Scoring: policies, risk, scorecards and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.paths import deleted_test_file, glob_key, glob_match, path_keys, sensitive_path
from changelens.operators.findings import REVIEWERS, SEVERITIES

# What a finding costs, and, below, the texts of risk factors, checks and headlines.
WEIGHTS = {"critical": 30, "high": 15, "medium": 6, "low": 2}


def validate_policy(rows: DataFrame) -> DataFrame:
    """rows(key, found, fail_on, min_score, ignore, path_instructions) with defaults filled in and warnings.

    A missing policy takes the defaults silently, an invalid one with a warning.
    """
    instructions = "array<struct<path:string,instructions:string>>"
    bad_text = lambda c, most: ~F.coalesce(F.length(c).between(1, most), F.lit(False))
    rules = [
        (F.exists("fail_on", lambda s: ~F.coalesce(s.isin(SEVERITIES), F.lit(False))), "fail_on: unknown severity"),
        (~F.col("min_score").between(0, 100), "min_score: must be 0 to 100"),
        (F.exists("ignore", lambda s: s.isNull()), "ignore: must be texts"),
        (F.size("path_instructions") > 50, "path_instructions: at most 50"),
        (F.exists("path_instructions", lambda p: bad_text(p["path"], 100_000) | bad_text(p["instructions"], 1000)), "path_instructions: an item is invalid"),
    ]
    broken = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(why)) for test, why in rules)))
    valid = F.coalesce("found", F.lit(False)) & (F.size("_broken") == 0)
    take = lambda name, default: F.when(valid, F.coalesce(F.col(name), default)).otherwise(default)
    return (
        rows.withColumn("_broken", broken)
        .withColumns({
            "warnings": F.when(
                F.coalesce("found", F.lit(False)) & (F.size("_broken") > 0),
                F.array(F.concat(F.lit("the policy has invalid settings ("), F.array_join("_broken", "; "), F.lit("); using defaults"))),
            ).otherwise(F.array().cast("array<string>")),
            "fail_on": take("fail_on", F.array(F.lit("critical"))),
            "min_score": take("min_score", F.lit(0)),
            "ignore": take("ignore", F.array().cast("array<string>")),
            "path_instructions": take("path_instructions", F.array().cast(instructions)),
        })
        .drop("_broken")
    )


def glob_hits(files: DataFrame, globs: DataFrame) -> DataFrame:
    """(review_id, filename, glob) of globs(review_id, glob) that match files(review_id, filename) of their review.

    Files and globs meet by equality of a folder, a name or an ending that the glob spells out, so a glob's pattern is
    held only against files that have it. A glob that spells out nothing meets all files of its review.
    """
    asked = globs.select("review_id", "glob").distinct().withColumn("at", glob_key(F.col("glob")))
    keyed = files.select("review_id", "filename").distinct().withColumn("at", F.explode(path_keys(F.col("filename"))))
    return keyed.join(asked, ["review_id", "at"]).filter(glob_match(F.col("filename"), F.col("glob"))).select("review_id", "filename", "glob")


def filter_ignored(files: DataFrame, policies: DataFrame) -> DataFrame:
    """files(review_id, filename, ...) that no ignore glob of the review's policy matches."""
    hit = glob_hits(files, policies.select("review_id", F.explode("ignore").alias("glob")))
    return files.join(hit.select("review_id", "filename"), ["review_id", "filename"], "left_anti")


def instructions_for(files: DataFrame, policies: DataFrame) -> DataFrame:
    """(review_id, place, path, instructions, files): path instructions that match changed files, in policy order."""
    rules = policies.select("review_id", F.posexplode("path_instructions").alias("place", "_i")).select("review_id", "place", F.col("_i.path").alias("glob"), F.col("_i.instructions").alias("instructions"))
    hit = glob_hits(files, rules).join(files.select("review_id", "ord", "filename"), ["review_id", "filename"])
    return (
        rules.join(hit, ["review_id", "glob"])
        .groupBy("review_id", "place", F.col("glob").alias("path"), "instructions")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "filename"))), lambda x: x["filename"]).alias("files"))
    )


def still_there(files: DataFrame) -> DataFrame:
    """The changed files that the new version has: a removed one touches nothing and nothing can depend on it."""
    return files.filter("status is null or status <> 'removed'")


def risk_inputs(files: DataFrame, kept: DataFrame, affected: DataFrame | None = None, fan_in: DataFrame | None = None) -> DataFrame:
    """What assess_risk needs of each review: lines of files that the policy keeps, paths of those of them that are still
    there, deleted tests of all files.

    changed_paths holds the first four sensitive ones, enough to name three and to tell that there are more.
    """
    base = files.groupBy("review_id").agg(F.count_if(deleted_test_file(F.col("status"), F.col("filename"))).alias("deleted_tests"))
    lines = kept.groupBy("review_id").agg(F.sum(F.col("additions") + F.col("deletions")).alias("lines_changed"))
    place = F.row_number().over(Window.partitionBy("review_id").orderBy("ord", "filename"))
    named = still_there(kept).filter(sensitive_path(F.col("filename"))).select("review_id", "ord", "filename").withColumn("place", place).filter("place <= 4")
    first = named.groupBy("review_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "filename"))), lambda x: x["filename"]).alias("changed_paths"))
    out = base.join(lines, "review_id", "left").join(first, "review_id", "left")
    none = F.lit(0).cast("long")
    out = out.join(affected.groupBy("review_id").agg(F.count("*").alias("affected")), "review_id", "left") if affected is not None else out.withColumn("affected", none)
    out = out.join(fan_in.select("review_id", "max_fan_in"), "review_id", "left") if fan_in is not None else out.withColumn("max_fan_in", none)
    return out.select(
        "review_id",
        F.coalesce("affected", none).alias("affected"),
        F.coalesce("max_fan_in", none).alias("max_fan_in"),
        F.coalesce("lines_changed", none).alias("lines_changed"),
        "deleted_tests",
        F.coalesce("changed_paths", F.array().cast("array<string>")).alias("changed_paths"),
    )


def assess_risk(inputs: DataFrame) -> DataFrame:
    """(review_id, score, level, factors) from additive parts, each with its limit."""
    hits = F.filter("changed_paths", sensitive_path)
    blast = F.least(F.lit(35), F.col("affected") * 2)
    size = F.least(F.lit(15), F.floor(F.col("lines_changed") / 50) * 3)
    many, sensitive, tests = F.col("max_fan_in") >= 10, F.size("_hits") > 0, F.col("deleted_tests") > 0
    part = lambda test, n: F.when(test, F.lit(n)).otherwise(0)
    score = F.least(F.lit(100), blast + part(many, 10) + part(sensitive, 30) + size + part(tests, 10)).cast("int")
    shown = F.concat(F.array_join(F.slice("_hits", 1, 3), ", "), F.when(F.size("_hits") > 3, "…").otherwise(""))
    say = lambda test, *words: F.when(test, F.concat(*words))
    number = lambda name: F.col(name).cast("string")
    factors = F.array_compact(F.array(
        say(blast > 0, number("affected"), F.lit(" file(s) depend on the changed code")),
        say(many, F.lit("a changed file is imported directly by "), number("max_fan_in"), F.lit(" files")),
        say(sensitive, F.lit("touches sensitive code: "), shown),
        say(size > 0, number("lines_changed"), F.lit(" lines changed")),
        say(tests, number("deleted_tests"), F.lit(" test file(s) deleted")),
    ))
    level = F.when(F.col("score") >= 70, "critical").when(F.col("score") >= 45, "high").when(F.col("score") >= 20, "medium").otherwise("low")
    return (
        inputs.withColumn("_hits", hits)
        .withColumn("score", score)
        .withColumn("factors", factors)
        .withColumn("factors", F.when(F.size("factors") > 0, F.col("factors")).otherwise(F.array(F.lit("small, isolated change"))))
        .select("review_id", "score", level.alias("level"), "factors")
    )


def penalty() -> Column:
    weight = F.lit(None).cast("double")
    for name, w in reversed(WEIGHTS.items()):
        weight = F.when(F.col("severity") == name, float(w)).otherwise(weight)
    return weight * F.when(F.col("verdict") == "uncertain", 0.5).otherwise(1.0)


def overall_score(findings: DataFrame, key: str = "review_id") -> DataFrame:
    """100 less the findings' weights, uncertain ones half, not below 0. Halves round up."""
    return findings.groupBy(key).agg(F.greatest(F.lit(0), F.floor(100 - F.sum(penalty()) + 0.5)).cast("int").alias("score"))


def dimension_scores(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """(review_id, dimension, score, note): quality, security and testing, from 10 down; a failed reviewer's is null.

    reviews(review_id, failed_reviewers). A finding counts in every dimension that it belongs to.
    """
    picks = {
        "quality": F.col("reviewer").isin("quality", "eslint"),
        "security": (F.col("reviewer") == "security") | (F.col("category") == "security"),
        "testing": F.col("reviewer") == "testing",
    }
    sums = findings.groupBy("review_id").agg(
        *(F.sum(F.when(test, penalty())).alias(f"{d}_p") for d, test in picks.items()), *(F.count_if(test).alias(f"{d}_n") for d, test in picks.items())
    )
    none = F.coalesce("failed_reviewers", F.array().cast("array<string>"))

    def row(d: str) -> Column:
        failed = F.array_contains(none, d)
        score = F.greatest(F.lit(0.0), F.floor((10 - F.coalesce(f"{d}_p", F.lit(0.0)) / 10) * 10 + 0.5) / 10)
        n = F.coalesce(f"{d}_n", F.lit(0))
        note = F.when(failed, "reviewer failed; not scored").when(n > 0, F.concat(n.cast("string"), F.lit(" finding(s)"))).otherwise("no issues found")
        return F.struct(F.lit(d).alias("dimension"), F.when(~failed, score).alias("score"), note.alias("note"))

    return reviews.join(sums, "review_id", "left").select("review_id", F.inline(F.array(*map(row, picks))))


def policy_decision(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """The gate: reviews(review_id, score, fail_on, min_score, warnings) with verdict, conclusion, headline, reasons, policies.

    Only findings that aren't uncertain and whose severity the policy names block; so does a score below its minimum.
    """
    policies = reviews.select("review_id", "score", "fail_on", "min_score", "warnings")
    text = lambda c: c.cast("string")
    reason = F.concat(
        "severity", F.lit(" "), "category", F.lit(" finding at "), F.coalesce("file", F.lit("PR")),
        F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(":"), text(F.col("line")))).otherwise(""),
    )
    blocks = (F.coalesce("verdict", F.lit("confirmed")) != "uncertain") & F.array_contains("fail_on", F.col("severity"))
    found = (
        findings.join(policies.select("review_id", "fail_on"), "review_id")
        .groupBy("review_id")
        .agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(blocks, F.struct("ord", reason.alias("reason"))))).alias("_blocking"))
    )
    out = policies.join(found, "review_id", "left").withColumns({
        "n": F.coalesce("n", F.lit(0)),
        "blocking": F.coalesce(F.transform("_blocking", lambda b: b["reason"]), F.array().cast("array<string>")),
        "low": F.col("score") < F.col("min_score"),
    })
    low_text = F.concat(F.lit("score "), text(F.col("score")), F.lit(" is below min_score "), text(F.col("min_score")))
    reasons = F.concat("blocking", F.when(F.col("low"), F.array(low_text)).otherwise(F.array().cast("array<string>")))
    names = F.array_join("fail_on", "/")
    check = lambda id_, status, message: F.struct(id_.alias("id"), status.alias("status"), message.alias("message"))
    fails = lambda test: F.when(test, "fail").otherwise("pass")
    fail_on = (
        F.when(F.size("fail_on") == 0, "no severities block merging")
        .when(F.size("blocking") > 0, F.concat(text(F.size("blocking")), F.lit(" confirmed "), names, F.lit(" finding(s)")))
        .otherwise(F.concat(F.lit("no confirmed "), names, F.lit(" findings")))
    )
    minimum = F.when(
        F.col("min_score") > 0, F.concat(F.lit("score "), text(F.col("score")), F.lit(" vs minimum "), text(F.col("min_score")))
    ).otherwise("no minimum score")
    warned = F.transform("warnings", lambda w, i: check(F.concat(F.lit("config_"), text(i + 1)), F.lit("warn"), w))
    checks = F.concat(F.array(check(F.lit("fail_on"), fails(F.size("blocking") > 0), fail_on), check(F.lit("min_score"), fails(F.col("low")), minimum)), warned)
    blocked, some = F.size("reasons") > 0, F.col("n") > 0
    more = F.when(F.size("reasons") > 1, F.concat(F.lit(" (+"), text(F.size("reasons") - 1), F.lit(" more)"))).otherwise("")
    return out.withColumn("reasons", reasons).select(
        "review_id",
        F.when(blocked, "request_changes").when(some, "comment").otherwise("approve").alias("verdict"),
        F.when(blocked, "failure").otherwise("success").alias("conclusion"),
        F.when(blocked, F.concat(F.lit("Blocked by policy: "), F.element_at("reasons", 1), more))
        .when(some, F.concat(F.lit("Passes policy with "), text(F.col("n")), F.lit(" finding(s) worth a look")))
        .otherwise("Passes policy; no issues found")
        .alias("headline"),
        "reasons",
        checks.alias("policies"),
    )


def severity_summary(findings: DataFrame, key: str = "review_id") -> DataFrame:
    """(key, critical, high, medium, low, summary): counts, and those above 0 as text."""
    counts = findings.groupBy(key).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    parts = F.array(*(F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in SEVERITIES))
    return counts.withColumn("summary", F.array_join(F.array_compact(parts), ", "))


def verification_summary(judged: DataFrame, failed: DataFrame) -> DataFrame:
    """(review_id, status, confirmed, uncertain, rejected); partial where a batch(review_id, batch) failed."""
    counts = judged.groupBy("review_id").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("confirmed", "uncertain", "rejected")))
    down = failed.groupBy("review_id").agg(F.count("*").alias("_down"))
    status = F.when(F.coalesce("_down", F.lit(0)) > 0, "partial").otherwise("complete")
    return counts.join(down, "review_id", "left").select("review_id", status.alias("status"), "confirmed", "uncertain", "rejected")


def token_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("review_id").agg(F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))


def reviewer_status(calls: DataFrame) -> DataFrame:
    """(review_id, failed_reviewers, skills, all_failed) of calls(review_id, reviewer, ok), in the reviewers' order."""
    failed = F.collect_set(F.when(~F.col("ok"), F.col("reviewer")))
    order = lambda names: F.filter(F.array(*map(F.lit, REVIEWERS)), lambda r: F.array_contains(names, r))
    return (
        calls.groupBy("review_id")
        .agg(failed.alias("_failed"), F.collect_set(F.when(F.col("ok"), F.col("reviewer"))).alias("_ok"), F.every(~F.col("ok")).alias("all_failed"))
        .select("review_id", order(F.col("_failed")).alias("failed_reviewers"), order(F.col("_ok")).alias("skills"), "all_failed")
    )


def distinct_categories(findings: DataFrame) -> DataFrame:
    return findings.groupBy("review_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))

