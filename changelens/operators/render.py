"""Texts for models and people: prompts, context, comments, summaries and the record of a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.paths import sensitive_path
from changelens.functions.text import CLAIM_TAGS, REVIEW_TAGS, estimate_tokens, fence, line_context
from changelens.operators.findings import SEVERITIES

# The signs of severities. The sentences for people below are fixed as well.
ICONS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵"}


def text(value: Column) -> Column:
    return value.cast("string")


def icon(severity: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in ICONS.items() for x in pair))[severity]


def place_of(file: Column, line: Column) -> Column:
    return F.concat(F.coalesce(file, F.lit("PR")), F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit(":"), text(line))).otherwise(""))


def review_prompt(reviews: DataFrame) -> DataFrame:
    """reviews(title, body, lint, diff_text, skipped) with prompt.

    lint is an array of (file, line, rule_id, message), skipped of (filename, reason). Title and description are the
    author's words and are fenced.
    """
    lint = F.array_join(
        F.transform("lint", lambda x: F.concat(x["file"], F.lit(":"), text(x["line"]), F.lit(" ["), x["rule_id"], F.lit("] "), x["message"])), "\n"
    )
    lint = F.when(F.coalesce(F.size("lint"), F.lit(0)) > 0, lint).otherwise("(none)")
    body = fence(F.substring(F.coalesce("body", F.lit("")), 1, 4000), REVIEW_TAGS)
    skipped = F.when(
        F.coalesce(F.size("skipped"), F.lit(0)) > 0,
        F.concat(F.lit("\nNot shown (do not review): "), F.array_join(F.transform("skipped", lambda s: F.concat(s["filename"], F.lit(" ("), s["reason"], F.lit(")"))), ", ")),
    ).otherwise("")
    prompt = F.concat(
        F.lit("<untrusted>\nPR title: "), fence(F.col("title"), REVIEW_TAGS), F.lit("\nPR description:\n"), F.when(body == "", "(empty)").otherwise(body),
        F.lit("\n</untrusted>\n\n<tool_findings>\n"), fence(lint, REVIEW_TAGS), F.lit("\n</tool_findings>\n\n<diff>\n"), F.col("diff_text"), F.lit("\n</diff>"), skipped,
    )
    return reviews.withColumn("prompt", prompt)


def render_context(contexts: DataFrame, budget: int = 6000) -> DataFrame:
    """contexts(review_id, reviewer, rules, callers, affected, related) with context, its blocks within the budget.

    rules(path, files, instructions), callers(symbol, path, line, snippet), affected(path, distance, via) and
    related(path, start_line, end_line, symbol, content) are arrays in order. A block that doesn't fit is passed over;
    at the first related one that doesn't fit, the rest are left out. The security reviewer sees sensitive paths first.
    """
    rules = F.concat(
        F.lit("<team_rules>\n"),
        F.array_join(F.transform("rules", lambda r: F.concat(F.lit("- "), r["path"], F.lit(" (applies to "), F.array_join(r["files"], ", "), F.lit("): "), r["instructions"])), "\n"),
        F.lit("\n</team_rules>"),
    )
    caller = lambda c: F.concat(
        F.lit('<callers of="'), c["symbol"], F.lit('" path="'), c["path"], F.lit('" line="'), text(c["line"]), F.lit('">\n'), fence(c["snippet"]), F.lit("\n</callers>")
    )
    affected = F.concat(
        F.lit('<affected_files count="'), text(F.size("affected")), F.lit('">\n'),
        F.array_join(F.transform(F.slice("affected", 1, 40), lambda a: F.concat(a["path"], F.lit(" (distance "), text(a["distance"]), F.lit(", via "), a["via"], F.lit(")"))), "\n"),
        F.lit("\n</affected_files>"),
    )
    related = lambda r: F.concat(
        F.lit('<related_code path="'), r["path"], F.lit('" lines="'), text(r["start_line"]), F.lit("-"), text(r["end_line"]), F.lit('"'),
        F.when(r["symbol"].isNotNull(), F.concat(F.lit(' symbol="'), r["symbol"], F.lit('"'))).otherwise(""),
        F.lit(">\n"), fence(F.substring(r["content"], 1, 3000)), F.lit("\n</related_code>"),
    )
    first = F.when(
        F.col("reviewer") == "security",
        F.concat(F.filter("related", lambda r: sensitive_path(r["path"])), F.filter("related", lambda r: ~sensitive_path(r["path"]))),
    ).otherwise(F.col("related"))
    block = lambda b, stops: F.struct(b.alias("text"), F.lit(stops).alias("stops"))
    none = F.array().cast("array<struct<text:string,stops:boolean>>")
    blocks = F.concat(
        F.when(F.size("rules") > 0, F.array(block(rules, False))).otherwise(none),
        F.transform("callers", lambda c: block(caller(c), False)),
        F.when(F.size("affected") > 0, F.array(block(affected, False))).otherwise(none),
        F.transform(first, lambda r: block(related(r), True)),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("parts"), F.lit(False).alias("over"))

    def add(a, b):
        cost = estimate_tokens(b["text"])
        fits = ~a["over"] & (a["used"] + cost <= budget)
        return F.struct(
            F.when(fits, a["used"] + cost).otherwise(a["used"]).alias("used"),
            F.when(fits, F.concat(a["parts"], F.array(b["text"]))).otherwise(a["parts"]).alias("parts"),
            (a["over"] | (b["stops"] & ~fits)).alias("over"),
        )

    return contexts.withColumn("context", F.array_join(F.aggregate(blocks, start, add)["parts"], "\n\n"))


def code_window(content: Column, patch: Column, line: Column, radius: int = 15) -> Column:
    """The marked lines around a finding; else its file's numbered patch; else a note."""
    has = (F.coalesce(content, F.lit("")) != "") & (F.coalesce(line, F.lit(0)) != 0)
    return F.when(has, line_context(content, line, radius, marked=True)).otherwise(F.coalesce(F.substring(patch, 1, 4000), F.lit("(code not available)")))


def verify_prompt(batched: DataFrame) -> DataFrame:
    """(review_id, batch, prompt) of findings(review_id, batch, batch_id, file, line, severity, category, message, window, team_rules)."""
    one = F.concat(
        F.lit('<finding id="'), text(F.col("batch_id")), F.lit('">\nfile: '), F.coalesce("file", F.lit("null")), F.lit(":"), F.coalesce(text(F.col("line")), F.lit("null")),
        F.lit("\nseverity: "), "severity", F.lit(" · category: "), "category", F.lit("\nclaim: <untrusted>"), fence(F.col("message"), CLAIM_TAGS),
        F.lit("</untrusted>\n<code>\n"), "window", F.lit("\n</code>\n</finding>"),
    )
    grouped = batched.groupBy("review_id", "batch").agg(F.sort_array(F.collect_list(F.struct("batch_id", one.alias("one")))).alias("_ones"), F.first("team_rules").alias("_rules"))
    rules = F.when(F.coalesce("_rules", F.lit("")) != "", F.concat(F.lit("<team_rules>\n"), "_rules", F.lit("\n</team_rules>\n"))).otherwise("")
    return grouped.select("review_id", "batch", F.array_join(F.concat(F.array(rules), F.transform("_ones", lambda x: x["one"])), "\n").alias("prompt"))


def finding_comment() -> Column:
    """A finding as a comment; its suggestion is fenced where it looks like code."""
    code = F.col("suggestion").rlike(r"[\n;{}()=]")
    suggestion = F.when(
        F.coalesce("suggestion", F.lit("")) != "",
        F.concat(F.lit("\n\n**Suggestion**\n"), F.when(code, F.concat(F.lit("```\n"), "suggestion", F.lit("\n```"))).otherwise(F.col("suggestion"))),
    ).otherwise("")
    lint = F.when(F.col("source") == "eslint", " · ESLint").otherwise("")
    return F.concat(icon(F.col("severity")), F.lit(" **"), F.upper("severity"), F.lit("** · "), "category", lint, F.lit("\n\n"), "message", suggestion)


def review_summary_markdown(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """(review_id, markdown) of reviews(review_id, score, summary, details_url) and findings(review_id, ord, severity, file, line, message, inline)."""
    off = F.when(~F.col("inline"), F.struct("ord", F.concat(F.lit("- "), icon(F.col("severity")), F.lit(" `"), place_of(F.col("file"), F.col("line")), F.lit("` "), "message").alias("row")))
    counts = findings.groupBy("review_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.sort_array(F.collect_list(off)).alias("_off"))
    line = F.array_join(F.array(*(F.concat(F.lit(f"{ICONS[s]} "), text(F.coalesce(s, F.lit(0))), F.lit(f" {s}")) for s in SEVERITIES)), " · ")
    rows = F.array_join(F.transform("_off", lambda x: x["row"]), "\n")
    details = F.when(
        F.coalesce(F.size("_off"), F.lit(0)) > 0,
        F.concat(F.lit("\n\n<details><summary>"), text(F.size("_off")), F.lit(" finding(s) outside the changed lines</summary>\n\n"), rows, F.lit("\n</details>")),
    ).otherwise("")
    link = F.when(F.coalesce("details_url", F.lit("")) != "", F.concat(F.lit("\n\n[Open the full review]("), "details_url", F.lit(")"))).otherwise("")
    head = F.concat(F.lit("### 🛡️ Review: "), F.format_string("%.1f", F.col("score") / 10), F.lit("/10\n\n"))
    return reviews.join(counts, "review_id", "left").select("review_id", F.concat(head, "summary", F.lit("\n\n"), line, details, link).alias("markdown"))


def review_summary_text(reviews: DataFrame) -> DataFrame:
    """reviews(intent_summary, n_files, level, factors, n_findings, counts, n_rejected) with summary, a few sentences."""
    found = F.when(F.col("n_findings") > 0, F.concat(F.lit("Found "), text(F.col("n_findings")), F.lit(" issue(s): "), "counts", F.lit("."))).otherwise("No issues found.")
    parts = F.array(
        F.coalesce("intent_summary", F.concat(F.lit("Reviewed "), text(F.col("n_files")), F.lit(" file(s)."))),
        F.concat(F.lit("Risk: "), "level", F.lit(" ("), F.element_at("factors", 1), F.lit(").")),
        found,
        F.when(F.col("n_rejected") > 0, F.concat(text(F.col("n_rejected")), F.lit(" possible issue(s) were checked and rejected."))),
    )
    return reviews.withColumn("summary", F.array_join(F.filter(F.array_compact(parts), lambda p: p != ""), " "))


def recommendations(reviews: DataFrame) -> DataFrame:
    """reviews(verdict, reasons, level, factors, failed_reviewers, alignment) with recommendations."""
    parts = F.array(
        F.when(F.col("verdict") == "request_changes", F.concat(F.lit("Fix before merging: "), F.array_join(F.slice("reasons", 1, 3), "; "))),
        F.when(F.col("level").isin("high", "critical"), F.concat(F.lit("High-impact change ("), F.array_join(F.slice("factors", 1, 2), "; "), F.lit("): ask a second human reviewer."))),
        F.when(F.size("failed_reviewers") > 0, F.concat(F.lit("Re-run the review: the "), F.array_join("failed_reviewers", " and "), F.lit(" reviewer(s) failed."))),
        F.when(F.col("alignment") == "misaligned", "The code doesn't match the PR description; update one of them."),
    )
    return reviews.withColumn("recommendations", F.array_compact(parts))


def check_summary(reviews: DataFrame) -> DataFrame:
    """reviews(conclusion, headline, policies, level, risk_score, factors) with check_title and check_text, held to their limits."""
    mark = lambda s: F.when(s == "pass", "✅").when(s == "warn", "⚠️").otherwise("❌")
    lines = F.array_join(F.transform("policies", lambda p: F.concat(F.lit("- "), mark(p["status"]), F.lit(" "), p["message"])), "\n")
    risk = F.concat(F.lit("**Risk:** "), "level", F.lit(" ("), text(F.col("risk_score")), F.lit("/100): "), F.array_join("factors", "; "))
    return reviews.withColumns({
        "check_title": F.substring("headline", 1, 255),
        "check_text": F.substring(F.concat("headline", F.lit("\n\n"), lines, F.lit("\n\n"), risk), 1, 65_000),
    })


def assurance_record(reviews: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(review_id, assurance): the decision with all that led to it, as JSON. A review without files has no scorecard."""
    scores = dimensions.groupBy("review_id").agg(F.sort_array(F.collect_list(F.struct("dimension", "score", "note"))).alias("_dimensions"))
    joined = reviews.join(scores, "review_id", "left")
    empty = F.coalesce("n_files", F.lit(0)) == 0
    intent = F.when(F.col("intent_summary").isNotNull(), F.struct(F.col("intent_summary").alias("summary"), "change_type", "stated"))
    alignment = F.when(F.col("intent_summary").isNotNull(), F.struct("alignment", "alignment_score", "alignment_summary"))
    record = F.struct(
        F.struct("verdict", "conclusion", "headline", "reasons").alias("decision"),
        F.when(~empty, F.struct((F.col("score") / 10).alias("overall"), F.col("_dimensions").alias("dimensions"))).alias("scorecard"),
        "policies",
        F.struct(F.col("risk_score").alias("score"), "level", "factors").alias("risk"),
        F.when(~empty, intent).alias("intent"),
        F.when(~empty, alignment).alias("alignment"),
        F.when(empty, F.array().cast("array<string>")).otherwise(F.col("recommendations")).alias("recommendations"),
        F.when(empty, F.array().cast("array<string>")).otherwise(F.col("skills")).alias("skills"),
        F.when(~empty, F.struct(F.col("verification_status").alias("status"), "confirmed", "uncertain", "rejected")).alias("verification"),
    )
    return joined.select("review_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("assurance"))
