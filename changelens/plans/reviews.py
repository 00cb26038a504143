"""Compositions: the context of reviews, one-call reviews, and staged ones with verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import rag_query_text
from changelens.operators import diff, findings, graph, index, render, retrieval, scoring
from changelens.operators.findings import REVIEWERS
from changelens.sources.tables import settled

#: (texts) -> [(answer, tokens)]; a None answer is a failed call.
Model = Callable[[list[str]], list[tuple[str | None, int]]]


def infer(prompts: DataFrame, model: Model, kind: str, *keys: str) -> DataFrame:
    """prompts(keys, prompt) with data, tokens and error: the model's validated answers.

    An invalid answer goes back once, with what is wrong. Validation splits the rows between the two calls, so only
    invalid ones are asked again. What fails twice has an error and no data. First answers are a written table, so a lost
    executor doesn't ask the model anew for what is there.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            answers = model(rows["prompt"].tolist())
            yield rows.assign(text=[a for a, _ in answers], tokens=[t for _, t in answers])

    def call(df: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        answered = df.mapInPandas(ask, f"{schema}, text string, tokens bigint")
        return findings.validate_model_output(answered, kind)

    first = settled(call(prompts.select(*keys, "prompt")), "answers")
    valid = first.filter("error is null")
    failed = F.concat(F.lit("Your previous answer failed validation:\n"), F.substring("error", 1, 1500), F.lit("\nReturn the corrected JSON object only."))
    repair = F.concat("prompt", F.lit("\n\n"), F.substring(F.coalesce("text", F.lit("")), 1, 8000), F.lit("\n\n"), failed)
    again = first.filter("error is not null").select(*keys, repair.alias("prompt"), F.col("tokens").alias("before"))
    second = call(again.select(*keys, "prompt", "before")).withColumn("tokens", F.col("tokens") + F.col("before")).drop("before")
    twice = F.when(F.col("error").isNotNull(), F.concat(F.lit("model output failed validation twice: "), F.substring("error", 1, 300)))
    second = second.withColumn("error", twice)
    columns = [*keys, "data", "tokens", "error"]
    return valid.select(*columns).unionByName(second.select(*columns)).withColumn("data", F.when(F.col("error").isNull(), F.col("data")))


def review_context(
    files: DataFrame, policies: DataFrame, code_files: DataFrame, contents: DataFrame, chunks: DataFrame | None = None, embedder=None, dims: int = 384,
    repositories: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """What a review is told beside its diff: kept files, affected files, callers, related chunks, rules and risk.

    files(review_id, repository_id, ord, filename, status, additions, deletions, patch); contents(review_id, ord, path,
    content) are new versions of changed files and of their importers. Of changed files, the first 30 that head_files
    names are read; removed files change nothing that is left, so they count in lines and deleted tests only.

    repositories(id, installation_id, indexed_sha), if given, says which have an index: the others' reviews get no affected
    files, callers or related chunks, and index_requests asks for an index of each, once. Without chunks there is
    nothing related.
    """
    kept = scoring.filter_ignored(files, policies)
    changed = scoring.still_there(kept).select("review_id", "repository_id", F.col("ord").alias("rank"), F.col("filename").alias("path"))
    out = {}
    if repositories is not None:
        asked = files.select("repository_id").distinct()
        missing = repositories.filter("indexed_sha is null").select(F.col("id").alias("repository_id"), "installation_id")
        out["index_requests"] = missing.join(asked, "repository_id", "left_semi").select("*", F.lit(None).cast("string").alias("ref"), F.lit("review").alias("reason"))
        indexed = repositories.filter("indexed_sha is not null").select(F.col("id").alias("repository_id"))
        changed = changed.join(indexed, "repository_id", "left_semi")
        code_files = code_files.join(indexed, "repository_id", "left_semi")
    heads = diff.head_content_files(kept).select("review_id", F.col("filename").alias("path"), "place")
    affected = settled(graph.blast_radius(changed, graph.reverse_edges(code_files)), "affected")
    lines = diff.parse_patch(kept, "review_id", "filename")
    added = diff.added_lines(lines).select("review_id", F.col("filename").alias("path"), F.col("new_line").alias("line"))
    symbols = index.changed_symbols(index.declarations(contents.join(heads, ["review_id", "path"], "left_semi")), added)
    near = graph.nearest_caller_files(affected).select("review_id", "path")
    callers = graph.find_callers(symbols, contents.join(near, ["review_id", "path"], "left_semi"))
    inputs = scoring.risk_inputs(files, kept, affected, graph.max_fan_in(changed, code_files))
    out |= {
        "files": kept, "head_files": heads, "affected": affected, "callers": callers, "symbols": symbols,
        "rules": scoring.instructions_for(kept, policies), "risk": scoring.assess_risk(inputs),
    }
    if chunks is not None:
        asking = kept if repositories is None else kept.join(indexed, "repository_id", "left_semi")
        listed = asking.groupBy("review_id", "repository_id").agg(F.sort_array(F.collect_list(F.struct("ord", "filename", "patch"))).alias("fs"))
        asked = listed.select("review_id", "repository_id", rag_query_text(F.col("fs")).alias("text"))
        out["related"] = retrieval.rag_top_k(retrieval.embed(asked, embedder, dims=dims), chunks, changed.select("review_id", "path"))
    return out


def single_pass_review(reviews: DataFrame, files: DataFrame, lint: DataFrame, model: Model, budget: int = 12_000) -> tuple[DataFrame, DataFrame]:
    """(reviews with summary and score, findings): one call a review; without anything to review, 100 and no call."""
    packed = diff.pack_diff(files, budget)
    inputs = reviews.join(packed, "review_id", "left").join(lint_lists(lint), "review_id", "left").withColumn("diff_text", F.coalesce("text", F.lit("")))
    some = F.coalesce(F.size("included"), F.lit(0)) > 0
    answers = settled(infer(render.review_prompt(inputs.filter(some)), model, "review", "review_id"), "review-answers")
    empty = F.lit("No reviewable code changes (only deleted, binary, generated or lock files).")
    scored = inputs.select("review_id", some.alias("some")).join(answers.drop("tokens"), "review_id", "left").select(
        "review_id",
        F.when(~F.col("some"), empty).otherwise(F.col("data.summary")).alias("summary"),
        F.when(~F.col("some"), F.lit(100)).otherwise(F.col("data.score").try_cast("int")).alias("score"),
        "error",
    )
    found = answers.filter("error is null").select("review_id", F.lit("quality").alias("reviewer"), F.posexplode("data.findings").alias("ord", "f"))
    return scored, ground(found, packed, files, lint.withColumn("reviewer", F.lit("quality")))


def lint_lists(lint: DataFrame) -> DataFrame:
    row = F.struct("ord", "file", "line", "rule_id", "message")
    return lint.groupBy("review_id").agg(F.sort_array(F.collect_list(row)).alias("lint"))


def ground(found: DataFrame, packed: DataFrame, files: DataFrame, lint: DataFrame) -> DataFrame:
    """Answers(review_id, reviewer, ord, f) as findings that hold against the packed files."""
    rows = found.select("review_id", "reviewer", "ord", "f.*").withColumn("line", F.col("line").try_cast("int"))
    shown = packed.select("review_id", F.explode("included").alias("file"))
    lines = diff.commentable_lines(diff.parse_patch(files, "review_id", "filename")).select("review_id", F.col("filename").alias("file"), F.col("new_line").alias("line"))
    return findings.ground_findings(rows, shown, lines, lint)


def staged_review(
    reviews: DataFrame, files: DataFrame, lint: DataFrame, contexts: DataFrame, policies: DataFrame, risk: DataFrame, contents: DataFrame,
    reviewer: Model, verifier: Model, intent: Model | None = None, budget: int = 12_000, intent_budget: int = 4000,
) -> dict[str, DataFrame]:
    """What changed, three reviewers, merged, de-duplicated, verified, scored and decided, for all reviews at once.

    reviews(review_id, title, body); contexts(review_id, rules, callers, affected, related) as render_context takes
    them; policies as validate_policy gives them, by review_id; risk as assess_risk gives it; contents(review_id, file,
    content). intent tells what a change is for; without it the reviewer model is asked, and a failed answer is done
    without. The reviewer is a column, so the three calls are rows of one table. A reviewer that fails is named and its
    dimension isn't scored. A review with files to show that no reviewer answered for is in failed(review_id, error) and
    has no decision, whatever the cause. A review without anything to show is decided with a score of 100, without
    calls. A review that contexts don't name is reviewed by its diff alone, one that policies don't name by the default
    policy. What models answer is written, so every result speaks of the same answers.

    report(review_id, summary, score, recommendations, check_title, check_text) and assurance(review_id, assurance) are
    the texts for people; the other tables are what they are made of.
    """
    packed = settled(diff.pack_diff(files, budget), "packed")
    shown = F.coalesce(F.size("included"), F.lit(0))
    everything = reviews.join(packed, "review_id", "left").withColumn("n_files", shown).withColumn("diff_text", F.coalesce("text", F.lit("")))
    base = everything.filter("n_files > 0")
    none = F.array().cast("array<struct<ord:int,file:string,line:int,rule_id:string,message:string>>")
    intents = intent_answers(base.withColumn("lint", none), files, intent or reviewer, intent_budget)

    empty = {c: F.coalesce(c, F.array().cast(contexts.schema[c].dataType)) for c in contexts.columns if c != "review_id"}
    calls = base.join(contexts, "review_id", "left").withColumns(empty).withColumn("reviewer", F.explode(F.array(*map(F.lit, REVIEWERS))))
    calls = calls.join(lint_lists(lint), "review_id", "left").withColumn("lint", F.when(F.col("reviewer") == "quality", F.col("lint")).otherwise(none))
    prompts = render.review_prompt(render.render_context(calls)).withColumn("prompt", F.concat("context", F.lit("\n\n"), "prompt"))
    answers = settled(infer(prompts, reviewer, "reviewer", "review_id", "reviewer"), "reviewer-answers")
    status = scoring.reviewer_status(answers.select("review_id", "reviewer", F.col("error").isNull().alias("ok")))
    first = answers.groupBy("review_id").agg(F.min_by("error", F.array_position(F.array(*map(F.lit, REVIEWERS)), F.col("reviewer"))).alias("why"))
    status = status.filter("not all_failed")
    unreviewed = base.select("review_id").distinct().join(status, "review_id", "left_anti").join(first, "review_id", "left")
    failed = unreviewed.select("review_id", F.concat(F.lit("all reviewers failed: "), F.coalesce("why", F.lit("no answer"))).alias("error"))

    found = answers.filter("error is null").select("review_id", "reviewer", F.posexplode("data.findings").alias("ord", "f"))
    down = answers.filter("error is not null").select("review_id", "reviewer")
    grounded = ground(found, packed, files, lint.withColumn("reviewer", F.lit("quality"))).join(status.select("review_id"), "review_id", "left_semi")
    unique = settled(findings.dedupe_findings(findings.union_reviewer_findings(grounded, down)), "unique-findings")
    verdicts = verifier_answers(unique, files, contents, contexts, verifier)
    given = verdicts.filter("error is null").select("review_id", "batch", F.posexplode("data.verdicts").alias("ord", "v")).select(
        "review_id", "batch", "ord", F.col("v.id").try_cast("int").alias("id"), "v.verdict", F.col("v.confidence").try_cast("double").alias("confidence"), "v.reason"
    )
    unchecked = verdicts.filter("error is not null").select("review_id", "batch")
    judged = settled(findings.apply_verdicts(unique, given, unchecked), "judged-findings")
    kept = judged.filter("verdict <> 'rejected'")

    done = everything.join(failed, "review_id", "left_anti")
    score = done.select("review_id").join(scoring.overall_score(kept), "review_id", "left").withColumn("score", F.coalesce("score", F.lit(100)))
    texts = lambda *values: F.array(*map(F.lit, values)).cast("array<string>")
    default = {"fail_on": texts("critical"), "min_score": F.lit(0), "warnings": texts()}
    gate = score.join(policies.select("review_id", *default), "review_id", "left").withColumns({c: F.coalesce(c, value) for c, value in default.items()})
    decision = scoring.policy_decision(kept, gate)
    spent = [answers, verdicts, intents]
    tokens = scoring.token_usage(spent[0].select("review_id", "tokens").unionByName(spent[1].select("review_id", "tokens")).unionByName(spent[2].select("review_id", "tokens")))
    out = {
        "findings": kept, "rejected": judged.filter("verdict = 'rejected'"), "score": score, "decision": decision, "status": status, "tokens": tokens, "failed": failed,
        "dimensions": scoring.dimension_scores(kept, status), "verification": scoring.verification_summary(judged, unchecked), "risk": risk, "packed": packed, "intent": intents,
    }
    report = told(done.select("review_id", "n_files"), out, scoring.severity_summary(kept))
    return out | {"report": report, "assurance": render.assurance_record(report, out["dimensions"])}


def intent_answers(base: DataFrame, files: DataFrame, model: Model, budget: int) -> DataFrame:
    """What each review's change is for, by a call over a smaller diff: (review_id, data, tokens, error)."""
    small = diff.pack_diff(files, budget).select("review_id", F.col("text").alias("small_diff"))
    prompts = render.review_prompt(base.join(small, "review_id").withColumn("diff_text", F.col("small_diff")))
    return settled(infer(prompts, model, "intent", "review_id"), "intent-answers")


def verifier_answers(unique: DataFrame, files: DataFrame, contents: DataFrame, contexts: DataFrame, model: Model) -> DataFrame:
    """Batches of findings with their code and the team's rules, as a second model judges them: (review_id, batch, data, tokens, error)."""
    numbered = diff.number_patch(diff.parse_patch(files, "review_id", "filename"), "review_id", "filename").withColumnRenamed("filename", "file")
    rule = lambda r: F.concat(F.lit("- "), r["path"], F.lit(": "), r["instructions"])
    rules = contexts.select("review_id", F.array_join(F.transform("rules", rule), "\n").alias("team_rules"))
    windows = (
        findings.verify_batches(unique)
        .join(contents, ["review_id", "file"], "left")
        .join(numbered, ["review_id", "file"], "left")
        .join(rules, "review_id", "left")
        .withColumn("window", render.code_window(F.col("content"), F.col("numbered"), F.col("line")))
    )
    return settled(infer(render.verify_prompt(windows), model, "verdicts", "review_id", "batch"), "verifier-answers")


def told(done: DataFrame, parts: dict[str, DataFrame], counts: DataFrame) -> DataFrame:
    """The decided reviews with their texts: summary, recommendations, and the check's title and text."""
    d = F.col("data")
    intent = parts["intent"].filter("error is null").select(
        "review_id", d["summary"].alias("intent_summary"), d["changeType"].alias("change_type"), d["stated"].alias("stated"), d["alignment"].alias("alignment"),
        d["alignmentScore"].try_cast("double").alias("alignment_score"), d["alignmentSummary"].alias("alignment_summary"),
    )
    risk = parts["risk"].select("review_id", F.col("score").alias("risk_score"), "level", "factors")
    checked = parts["verification"].withColumnRenamed("status", "verification_status")
    names = F.array().cast("array<string>")
    zero = F.lit(0).cast("long")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("confirmed", "uncertain", "rejected")]
    counted = counts.select("review_id", F.col("summary").alias("counts"), F.expr("critical + high + medium + low").alias("n_findings"))
    rows = done.join(parts["decision"], "review_id")
    for more in (parts["score"], risk, intent, parts["status"].drop("all_failed"), checked, counted):
        rows = rows.join(more, "review_id", "left")
    rows = rows.select(
        *[c for c in rows.columns if c not in ("confirmed", "uncertain", "rejected", "n_findings", "failed_reviewers", "skills", "verification_status")],
        *numbers, F.coalesce("n_findings", zero).alias("n_findings"), F.coalesce("rejected", zero).alias("n_rejected"), F.coalesce("failed_reviewers", names).alias("failed_reviewers"),
        F.coalesce("skills", names).alias("skills"), F.coalesce("verification_status", F.lit("complete")).alias("verification_status"),
    )
    rows = render.check_summary(render.recommendations(render.review_summary_text(rows)))
    empty = F.lit("No reviewable code changes (only deleted, binary, generated, ignored or lock files).")
    return rows.withColumn("summary", F.when(F.col("n_files") > 0, F.col("summary")).otherwise(empty))
