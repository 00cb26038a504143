"""Findings: validation of model output, grounding, merging, near-duplicates and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.paths import ts_like
from changelens.functions.text import extract_json, jaccard, normalise_path, word_set

# What findings may say, who finds them, and lint rules that only make noise.
SEVERITIES = ["critical", "high", "medium", "low"]
CATEGORIES = ["security", "bug", "performance", "maintainability", "style"]
REVIEWERS = ["quality", "security", "testing"]
NOISY_RULES = ["no-undef", "@typescript-eslint/no-explicit-any", "@typescript-eslint/no-require-imports", "@typescript-eslint/no-empty-object-type"]
FINDING = "file string, line string, severity string, category string, message string, suggestion string"
SHAPES = {
    "review": f"summary string, score string, findings array<struct<{FINDING.replace(' string', ':string')}>>",
    "reviewer": f"findings array<struct<{FINDING.replace(' string', ':string')}>>",
    "intent": "summary string, changeType string, stated boolean, alignment string, alignmentScore string, alignmentSummary string",
    "verdicts": "verdicts array<struct<id:string,verdict:string,confidence:string,reason:string>>",
}


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low; unknown ones count as low."""
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)


def whole(text: Column) -> Column:
    """A number without fraction, given as a number or its text; null otherwise."""
    number = text.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def finding_invalid(f: Column) -> Column:
    """Whether any field of a finding breaks its rule."""
    length = lambda name, least, most: ~F.coalesce(F.length(f[name]).between(least, most), F.lit(False))
    return (
        (F.coalesce(f["file"], F.lit("")) == "")
        | ~F.coalesce(f["severity"].isin(SEVERITIES), F.lit(False))
        | ~F.coalesce(f["category"].isin(CATEGORIES), F.lit(False))
        | length("message", 5, 1000)
        | F.coalesce(F.length(f["suggestion"]) > 2000, F.lit(False))
        | ~F.coalesce(whole(f["line"]) > 0, F.lit(False))
    )


def validate_model_output(responses: DataFrame, kind: str, text_col: str = "text") -> DataFrame:
    """responses with data, the parsed answer, and error, null where the whole answer is valid. One bad item fails it."""
    d = F.col("data")
    among = lambda c, values: F.coalesce(c.isin(values), F.lit(False))
    within = lambda c, low, high: F.coalesce(c.between(low, high), F.lit(False))
    items = lambda name, most: [
        (d[name].isNull(), f"{name}: required"),
        (F.size(d[name]) > most, f"{name}: at most {most}"),
        (F.exists(d[name], finding_invalid), f"{name}: an item is invalid"),
    ]
    verdict = lambda v: (
        whole(v["id"]).isNull()
        | ~among(v["verdict"], ["confirmed", "rejected", "uncertain"])
        | ~within(v["confidence"].try_cast("double"), 0, 1)
        | F.coalesce(F.length(v["reason"]) > 600, F.lit(False))
    )
    rules = {
        "review": [(~within(F.length(d["summary"]), 1, 2000), "summary"), (~within(whole(d["score"]), 0, 100), "score"), *items("findings", 40)],
        "reviewer": items("findings", 25),
        "intent": [
            (~within(F.length(d["summary"]), 1, 600), "summary"),
            (~within(F.length(d["changeType"]), 1, 30), "changeType"),
            (d["stated"].isNull(), "stated"),
            (~among(d["alignment"], ["aligned", "partial", "misaligned", "unknown"]), "alignment"),
            (~within(d["alignmentScore"].try_cast("double"), 0, 10), "alignmentScore"),
            (F.coalesce(F.length(d["alignmentSummary"]) > 400, F.lit(False)), "alignmentSummary"),
        ],
        "verdicts": [(d["verdicts"].isNull(), "verdicts: required"), (F.exists(d["verdicts"], verdict), "verdicts: an item is invalid")],
    }[kind]
    broken = F.concat_ws("; ", *(F.when(F.coalesce(test, F.lit(False)), F.lit(why)) for test, why in rules))
    return (
        responses.withColumn("json", extract_json(F.col(text_col)))
        .withColumn("data", F.from_json("json", SHAPES[kind]))
        .withColumn("_broken", broken)
        .withColumn("error", F.when(F.col("json").isNull(), "no JSON object in the answer").when(F.col("_broken") != "", F.col("_broken")))
        .drop("json", "_broken")
    )


def lint_on_added_lines(lint: DataFrame, added: DataFrame, files: DataFrame, most_files: int = 20) -> DataFrame:
    """lint(review_id, file, line, rule_id, message, severity 1 or 2) on added lines of the first script files of files(review_id, ord, filename)."""
    scripts = files.filter(ts_like(F.col("filename")))
    place = F.row_number().over(Window.partitionBy("review_id").orderBy("ord"))
    first = scripts.withColumn("place", place).filter(F.col("place") <= most_files).select("review_id", F.col("filename").alias("file"))
    lines = added.select("review_id", "file", "line").distinct()
    return (
        lint.filter(F.col("rule_id").isNotNull() & ~F.col("rule_id").isin(NOISY_RULES))
        .join(first, ["review_id", "file"], "left_semi")
        .join(lines, ["review_id", "file", "line"], "left_semi")
        .withColumn("severity", F.when(F.col("severity") == 2, "error").otherwise("warning"))
    )


def among(rows: DataFrame, places: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows with name: whether places(on) has their values of on, none of which is null.

    What a left join with the distinct places tells, but rows and places that lie together by one of these columns
    aren't shuffled again, as a join by several columns would.
    """
    both = rows.withColumn("_row", F.lit(True)).unionByName(places.select(*on, F.lit(False).alias("_row")), allowMissingColumns=True)
    given = F.lit(True)
    for c in on:
        given &= F.col(c).isNotNull()
    hit = F.max(~F.col("_row")).over(Window.partitionBy(*on)) & given
    return both.withColumn(name, hit).filter("_row").drop("_row")


def of_known_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows(review_id, file) on one of files(review_id, file), which are few in a review."""
    known = files.groupBy("review_id").agg(F.collect_set("file").alias("_known"))
    return rows.join(known, "review_id").filter(F.array_contains("_known", F.col("file"))).drop("_known")


def ground_findings(found: DataFrame, files: DataFrame, commentable: DataFrame, lint: DataFrame, most: int = 30) -> DataFrame:
    """What of a reviewer's findings holds against the diff, joined by lint errors, at most `most` for each call.

    found(review_id, reviewer, ord, file, line, severity, category, message, suggestion); files(review_id, file);
    commentable(review_id, file, line); lint(review_id, reviewer, ord, file, line, rule_id, message, severity), each
    message given to the calls that are to see it. Findings on unknown files go, repeats of (file, line, first 60
    letters) too; others keep whether their line takes comments.
    """
    call = ["review_id", "reviewer"]
    model = found.withColumn("file", normalise_path(F.col("file"))).select(
        *call, "ord", "file", "line", "severity", "category", "message", "suggestion", F.lit("ai").alias("source"), F.lit(0).alias("part")
    )
    errors = lint.filter("severity = 'error'").select(
        *call,
        "ord",
        "file",
        "line",
        F.lit("medium").alias("severity"),
        F.lit("bug").alias("category"),
        F.concat("message", F.lit(" (ESLint: "), "rule_id", F.lit(")")).alias("message"),
        F.lit(None).cast("string").alias("suggestion"),
        F.lit("eslint").alias("source"),
        F.lit(1).alias("part"),
    )
    start = F.when(F.col("part") == 0, F.lower(F.substring("message", 1, 60)))
    repeat = F.row_number().over(Window.partitionBy(*call, "file", "line", "part", start).orderBy("ord"))
    said = (F.min("part").over(Window.partitionBy(*call, "file", "line")) == 0) & F.col("reviewer").isNotNull() & F.col("line").isNotNull()
    held = of_known_files(model.unionByName(errors), files).withColumns({"_repeat": repeat, "_said": said})
    held = held.filter(((F.col("part") == 0) & (F.col("_repeat") == 1)) | ((F.col("part") == 1) & ~F.col("_said"))).drop("_repeat", "_said")
    place = F.row_number().over(Window.partitionBy(*call).orderBy(severity_rank(F.col("severity")), "part", "ord", "file", "line"))
    return (
        among(held, commentable, ["review_id", "file", "line"], "inline")
        .withColumn("place", place)
        .filter(F.col("place") <= most)
        .select(*call, "place", "file", "line", "severity", "category", "message", "suggestion", "source", "inline")
    )


def top_findings(findings: DataFrame, n: int = 30, key: str = "review_id", order: str = "ord") -> DataFrame:
    """The n most severe of each key, earlier ones first among equals."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(severity_rank(F.col("severity")), order, *(["id"] if "id" in findings.columns else [])))
    return findings.withColumn("place", place).filter(F.col("place") <= n)


def union_reviewer_findings(grounded: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """All calls' findings in one order, quality, security, testing, without failed(review_id, reviewer) calls."""
    rank = F.array_position(F.array(*map(F.lit, REVIEWERS)), F.col("reviewer"))
    kept = grounded
    if failed is not None:  # a review has a few reviewers, so all that failed come as one row
        down = failed.groupBy("review_id").agg(F.collect_set("reviewer").alias("_down"))
        gone = F.coalesce(F.array_contains("_down", F.col("reviewer")), F.lit(False))
        kept = grounded.join(down, "review_id", "left").filter(~gone).drop("_down")
    order = F.row_number().over(Window.partitionBy("review_id").orderBy(rank, "place"))
    return kept.withColumn("ord", order).withColumn("reviewer", F.when(F.col("source") == "eslint", "eslint").otherwise(F.col("reviewer"))).drop("place")


def split_inline(findings: DataFrame, commentable: DataFrame) -> DataFrame:
    return among(findings, commentable, ["review_id", "file", "line"], "inline")


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """findings(review_id, ord, file, line, severity, category, message, ...) without near-duplicates of kept ones.

    From the most severe on, a finding goes if a kept one of its file has its line and category, or its line and a
    fifth of its words, or lies within two lines and shares 35 per cent of them. A null line counts as 0. A file's
    findings in one review, at most 30 for each of three calls, are folded as one array.
    """
    columns = [c for c in findings.columns if c not in ("review_id", "file")]
    row = F.struct(
        severity_rank(F.col("severity")).alias("_rank"), F.col("ord").alias("_ord"), F.coalesce("line", F.lit(0)).alias("_line"),
        word_set(F.coalesce("message", F.lit(""))).alias("_words"), F.struct(*columns).alias("_row"),
    )
    listed = findings.groupBy("review_id", "file").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def same(k: Column, f: Column) -> Column:
        gap, alike = F.abs(k["_line"] - f["_line"]), jaccard(k["_words"], f["_words"])
        category = k["_row"]["category"].eqNullSafe(f["_row"]["category"])
        return ((gap == 0) & (category | (alike >= 0.2))) | ((gap > 0) & (gap <= 2) & (alike >= 0.35))

    kind = listed.schema["rows"].dataType.simpleString()
    add = lambda kept, f: F.when(F.exists(kept, lambda k: same(k, f)), kept).otherwise(F.concat(kept, F.array(f)))
    kept = F.aggregate("rows", F.array().cast(kind), add)
    return listed.select("review_id", "file", F.explode(kept).alias("k")).select("review_id", "file", "k._row.*").select(*findings.columns)


def verify_batches(findings: DataFrame, size: int = 8) -> DataFrame:
    """Findings that a model is to check, with their batch and their number in it."""
    place = F.row_number().over(Window.partitionBy("review_id").orderBy("ord")) - 1
    return (
        findings.filter("source <> 'eslint'")
        .withColumn("_place", place)
        .withColumn("batch", F.floor(F.col("_place") / size).cast("int"))
        .withColumn("batch_id", (F.col("_place") % size).cast("int"))
        .drop("_place")
    )


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, failed: DataFrame, size: int = 8) -> DataFrame:
    """findings with verdict, confidence and reason; rejected ones keep the verdict 'rejected'.

    verdicts(review_id, batch, id, ord, verdict, confidence, reason): the first of an id counts. failed(review_id,
    batch). Lint findings are facts; what nobody judged is uncertain; an uncertain one has a confidence of 0.6 at most.
    """
    lint = findings.filter("source = 'eslint'").withColumns({
        "verdict": F.lit("confirmed"), "confidence": F.lit(0.8), "reason": F.lit(None).cast("string"),
    })
    first = verdicts.groupBy("review_id", "batch", F.col("id").alias("batch_id")).agg(F.min_by(F.struct("verdict", "confidence", "reason"), "ord").alias("_v"))
    down = failed.groupBy("review_id").agg(F.collect_set("batch").alias("_down"))  # a few a review
    judged = verify_batches(findings, size).join(down, "review_id", "left").join(first, ["review_id", "batch", "batch_id"], "left")
    none = F.coalesce(F.array_contains("_down", F.col("batch")), F.lit(False)) | F.col("_v").isNull()
    confidence = F.col("_v.confidence").cast("double")
    judged = judged.withColumns({
        "verdict": F.when(none, "uncertain").otherwise(F.col("_v.verdict")),
        "confidence": F.when(none, 0.5).when(F.col("_v.verdict") == "uncertain", F.least(confidence, F.lit(0.6))).otherwise(confidence),
        "reason": F.when(~none, F.col("_v.reason")),
    })
    columns = [*findings.columns, "verdict", "confidence", "reason"]
    return judged.select(*columns).unionByName(lint.select(*columns))
