"""The registered queries: each operator over the model tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import paths, text
from changelens.operators import diff, evals, events, findings, graph, index, lifecycle, registry, render, reports, retrieval, scoring
from changelens.plans import indexing
from changelens.sources.model import model
from changelens.sources.tables import decode_blob, ingest_diff_files as ingested, is_code_file, scan_tree as scanned, settled
from changelens.sources.topics import topic_key

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Registers f(m, table) under its name; m(name) is a model table, which `by` can deal out, table(name) a given one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda name, by=None: model(spark, sf_dir, name, by), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[f.__name__] = run
    return f


def distinct_findings(m) -> DataFrame:
    """Findings by unique id: rows that repeat in every column count once. Those of a review lie together."""
    return m("review_findings", "l_orderkey").distinct()


@query
def score_trend(m, table):
    seen = registry.scope_reviews(m("reviews"), registry.visible_repositories(m("installations"), m("repositories")))
    return reports.score_trend(seen, None, "user")


@query
def category_breakdown(m, table):
    return reports.category_breakdown(m("reviews"), m("review_findings"))


@query
def page_total(m, table):
    return reports.page_total(m("reviews"), 3, 15)


@query
def reviews_page(m, table):
    return reports.page(m("reviews"), [F.desc("created_at"), F.desc("id")], 3).select("id", "repo_full_name")


@query
def repository_counts(m, table):
    return reports.repository_counts(m("repositories"), "R1")


@query
def search_repositories(m, table):
    return reports.search_repositories(m("repositories"), "O1/r", "enabled").select("full_name")


@query
def search_reviews(m, table):
    return reports.search_reviews(m("reviews"), "42").select("id", "pr_number")


@query
def severity_badges(m, table):
    return reports.severity_badges(m("review_findings"))


@query
def review_group(m, table):
    return reports.review_group(m("reviews"), m("review_findings")).select("id", "group")


@query
def review_rows(m, table):
    return reports.review_row(m("reviews")).select("id", "title", "shown_score", "band")


@query
def review_details(m, table):
    """Every review with its findings inside, in their order."""
    issue = lambda i: F.concat_ws(" ", i["ord"], i["id"], i["file"], i["line"], i["severity"], i["status"])
    reviews = m("reviews").withColumns({"pr_url": F.concat(F.lit("https://host.example/"), "repo_full_name"), "review_url": F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://host.example/r"), F.col("id").cast("string")))})
    out = reports.review_detail(reviews, distinct_findings(m).withColumn("ord", F.col("ord").cast("int")))
    return out.select("id", "title", "github_url", F.size("issues").alias("n_issues"), F.md5(F.array_join(F.transform("issues", issue), ";")).alias("issues_md5"))


@query
def repository_rows(m, table):
    return reports.repository_row(m("repositories")).select("full_name", "account", "html_url")


@query
def user_installations(m, table):
    return registry.user_installations(m("installations")).select("owner_user_id", "installation_id", "place", "has_active")


@query
def accessible_repository(m, table):
    asked = registry.visible_repositories(m("installations"), m("repositories")).select("user", F.upper("repo_full_name").alias("name"))
    return registry.accessible_repository(asked, m("installations"), m("repositories")).select("user", "full_name")


@query
def deactivate_missing(m, table):
    granted = m("repositories").filter("installation_id % 2 = 0 and github_repo_id % 4 <> 0").select("installation_id", "github_repo_id")
    return registry.deactivate_missing(m("repositories"), granted).select("github_repo_id", "active")


@query
def missing_indexes(m, table):
    return events.request_missing_indexes(m("reviews"), m("repositories")).select("repository_id", "installation_id").distinct()


def pulls(m) -> DataFrame:
    return m("reviews").groupBy("repo_full_name", "pr_number").agg(F.min("head_sha").alias("pr_head_sha"))


@query
def latest_review_per_pr(m, table):
    return lifecycle.latest_review_per_pr(pulls(m), m("reviews")).select("repo_full_name", "pr_number", "review_id", "status", "outdated")


@query
def reviewed_pull_count(m, table):
    return lifecycle.reviewed_pull_count(lifecycle.latest_review_per_pr(pulls(m), m("reviews")))


@query
def previous_review(m, table):
    return lifecycle.previous_review(m("reviews").select("repo_full_name", "pr_number", "head_sha"), m("reviews"))


@query
def sweep_stuck(m, table):
    return lifecycle.sweep_stuck(m("reviews"), "1997-01-01").select("id", "new_status", "new_attempts")


@query
def daily_series(m, table):
    return reports.daily_series(reports.score_trend(m("reviews")), "1997-01-31")


@query
def dashboard_kpis(m, table):
    return reports.dashboard_kpis(reports.score_trend(m("reviews")), reports.category_breakdown(m("reviews"), m("review_findings")))


@query
def open_counts(m, table):
    return reports.open_counts(m("review_findings"))


@query
def issues_by_file(m, table):
    return reports.issues_by_file(m("review_findings")).withColumn("ids", F.array_join("ids", ","))


@query
def overall_score(m, table):
    return scoring.overall_score(m("review_findings"))


@query
def dimension_scores(m, table):
    failed = F.when(F.col("review_id") % 10 == 3, F.array(F.lit("testing"))).otherwise(F.array().cast("array<string>"))
    reviews = m("review_findings").select("review_id").distinct().withColumn("failed_reviewers", failed)
    return scoring.dimension_scores(m("review_findings"), reviews).select("review_id", "dimension", "score")


@query
def policy_decision(m, table):
    found = m("review_findings")
    reviews = scoring.overall_score(found).withColumns({
        "fail_on": F.array(F.lit("critical")), "min_score": F.lit(40), "warnings": F.array().cast("array<string>"),
    })
    return scoring.policy_decision(found, reviews).select(
        "review_id", "verdict", "conclusion", "headline", F.array_join("reasons", "; ").alias("reasons"),
        F.array_join(F.transform("policies", lambda p: F.concat_ws(" ", p["id"], p["status"], p["message"])), "; ").alias("policies"),
    )


@query
def severity_summary(m, table):
    return scoring.severity_summary(m("review_findings")).select("review_id", "summary")


@query
def verification_summary(m, table):
    failed = m("review_findings").filter("review_id % 5 = 0").select("review_id").distinct().withColumn("batch", F.lit(0))
    return scoring.verification_summary(m("review_findings"), failed)


@query
def distinct_categories(m, table):
    return scoring.distinct_categories(m("review_findings")).withColumn("categories", F.array_join("categories", ","))


@query
def top_findings(m, table):
    return findings.top_findings(m("review_findings"), 3).select("review_id", "id", "place")


@query
def verify_batches(m, table):
    found = distinct_findings(m).withColumn("ord", F.struct("ord", "id"))
    return findings.verify_batches(found, 2).select("review_id", "id", "batch", "batch_id")


@query
def split_inline(m, table):
    found = distinct_findings(m).filter("file is not null")
    return findings.split_inline(found, found.filter("line % 3 = 0")).select("review_id", "id", "inline")


@query
def dedupe_findings(m, table):
    found = distinct_findings(m).withColumn("ord", F.struct("ord", "id"))
    return findings.dedupe_findings(found).select("review_id", "id")


@query
def fan_in(m, table):
    return graph.fan_in(m("code_files"))


def changed_files(m) -> DataFrame:
    """Reviews of two files each, a file and the one before it by number."""
    number = F.expr("cast(regexp_extract(path, '([0-9]+)', 1) as bigint)")
    files = m("code_files").select("repository_id", "path", number.alias("number"))
    return files.select(F.explode(F.array("number", F.col("number") + 1)).alias("review_id"), "repository_id", F.col("number").alias("rank"), "path")


def affected(m) -> DataFrame:
    return graph.blast_radius(changed_files(m), graph.reverse_edges(m("code_files")))


@query
def blast_radius(m, table):
    return affected(m).select("review_id", "path", "distance", "via")


@query
def detect_file_changes(m, table):
    files = m("code_files")
    sha = F.when(F.length("path") % 3 == 0, "x").otherwise(F.col("blob_sha"))
    indexed = F.when(F.col("repository_id") % 5 == 0, "head")
    tree = files.filter("path not like '%3.ts'").select("repository_id", "path", sha.alias("sha"), F.lit("head").alias("target_sha"), indexed.alias("indexed_sha"))
    return index.detect_file_changes(tree, files.filter("path not like '%4.ts'")).select("repository_id", "path", "change")


@query
def rag_top_k(m, table):
    chunks = m("code_chunks").withColumn("path", F.col("id").cast("string"))
    asked = chunks.filter("id % 50 = 0").select(F.col("id").alias("review_id"), "repository_id", "embedding")
    own = asked.select("review_id", F.col("review_id").cast("string").alias("path"))
    return retrieval.rag_top_k(asked, chunks, own, max_distance=0.9).select("review_id", "id", "place")


def patches(m) -> DataFrame:
    """Files whose lines are, in turn, context, added, removed and context again, as one hunk each."""
    kinds = F.transform(F.split("content", "\n", -1), lambda line, i: F.concat(F.when(i % 4 == 1, "+").when(i % 4 == 2, "-").otherwise(" "), line))
    head = F.concat(F.lit("@@ -1,4 +"), (F.col("ord") % 30 + 1).cast("string"), F.lit(",6 @@ ctx\n"))
    return m("files").withColumn("patch", F.when(F.col("ord") % 7 != 0, F.concat(head, F.array_join(kinds, "\n"))))


@query
def classify_diff_files(m, table):
    return diff.classify_diff_files(patches(m)).select("review_id", "filename", "reason", "reviewable")


@query
def parse_patch(m, table):
    return diff.parse_patch(patches(m), "review_id", "ord").select("review_id", "ord", "i", "kind", "new_line", F.md5("text").alias("text_md5"))


@query
def number_patch(m, table):
    lines = diff.parse_patch(patches(m), "review_id", "ord")
    return diff.number_patch(lines, "review_id", "ord").select("review_id", "ord", F.md5("numbered").alias("numbered_md5"))


@query
def pack_diff(m, table):
    packed = diff.pack_diff(patches(m))
    return packed.select("review_id", F.size("included").alias("n_included"), F.size("skipped").alias("n_skipped"), F.length("text").alias("n_chars"))


@query
def line_windows(m, table):
    cut = m("files").select("ord", F.inline(text.line_windows(F.col("content"), size=6, step=5)))
    return cut.select("ord", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query
def word_similarity(m, table):
    words = table("conversations").select("conv_id", "turn", text.word_set(F.col("text")).alias("words"))
    after = words.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next"))
    return words.join(after, ["conv_id", "turn"]).select("conv_id", "turn", text.jaccard(F.col("words"), F.col("next")).alias("similarity"))


@query
def fenced_pages(m, table):
    fenced = text.fence(F.col("html"), "title|script|style|nav|untrusted")
    return table("pages").select("page_id", F.md5(fenced).alias("fenced_md5"), text.estimate_tokens(F.col("html")).alias("tokens"))


@query
def sensitive_paths(m, table):
    name = F.col("filename")
    return m("files").select(
        "filename",
        paths.sensitive_path(name).alias("sensitive"),
        paths.deleted_test_file(F.col("status"), name).alias("deleted_test"),
        is_code_file(name).alias("code"),
    )


def hub_code(m) -> DataFrame:
    """The code files, each importing also the first of its repository."""
    hub = F.expr("concat('src/p', cast(regexp_extract(path, '([0-9]+)', 1) as bigint) div 100 * 100, '.ts')")
    return m("code_files").withColumn("imports", F.filter(F.concat("imports", F.array(hub)), lambda x: x != F.col("path")))


@query
def risk(m, table):
    """Reviews of three documents; every third one also changes a code file."""
    files = m("files").withColumn("review_id", F.expr("cast(ord div 3 as bigint)"))
    globs = files.select("review_id").distinct().withColumn("ignore", F.array(F.lit("dist/**")))
    number = F.expr("cast(regexp_extract(path, '([0-9]+)', 1) as bigint)")
    changed = m("code_files").filter(number % 30 == 0).select(F.expr("cast(regexp_extract(path, '([0-9]+)', 1) as bigint) div 10").alias("review_id"), "repository_id", F.lit(0).alias("rank"), "path")
    reached = graph.blast_radius(changed, graph.reverse_edges(hub_code(m)))
    inputs = scoring.risk_inputs(files, scoring.filter_ignored(files, globs), reached, graph.max_fan_in(changed, hub_code(m)))
    return scoring.assess_risk(inputs).select("review_id", "score", "level", F.array_join("factors", "; ").alias("factors"))


@query
def ingest_events(m, table):
    return lifecycle.ingest_events(m("webhook_events")).select("event_id", "duplicate")


@query
def sweep_outbox(m, table):
    return lifecycle.sweep_outbox(m("webhook_events"), "2024-01-05").select("event_id", "delivery_id")


@query
def sweep_results(m, table):
    """The sweep's fifty events when the broker refuses some of them."""
    picked = lifecycle.sweep_outbox(m("webhook_events"), "2024-01-05")
    errors = m("webhook_events").filter("event_id % 8 = 5").select("event_id", F.concat(F.lit("refused d"), F.col("event_id").cast("string")).alias("error"))
    out = lifecycle.sweep_results(picked, errors, "2024-01-05")
    return out.select("event_id", "outcome", "new_status", "new_error", F.unix_timestamp("published_at").alias("published_s"))


@query
def mark_published(m, table):
    sent = m("webhook_events").filter("event_id % 4 <> 1").select("delivery_id", F.timestamp_seconds(F.lit(1704067200) + F.col("event_id")).alias("sent_at"))
    return lifecycle.mark_published(m("webhook_events"), sent).select("event_id", "status", F.unix_timestamp("published_at").alias("published_s"))


@query
def registry_sync(m, table):
    """Events over stored repositories, whose switch and known values stay."""
    action = F.get_json_object("payload", "$.action")
    none = F.lit(None).cast("string")
    changes = m("webhook_events").select(
        "github_repo_id", F.lit(1).cast("long").alias("installation_id"), F.col("received_at").alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit("new/r"), F.col("github_repo_id").cast("string")).alias("full_name"),
        F.lit(False).alias("private"), F.when(F.col("event_id") % 5 == 0, F.lit("https://host.example/new")).alias("html_url"), none.alias("language"), none.alias("description"), (action == "closed").alias("removed"),
    )
    stored = m("repositories").withColumn("description", none)
    return registry.registry_repositories(changes, stored).select("github_repo_id", "full_name", "html_url", "language", "active", "auto_review_enabled")


@query
def parsed_events(m, table):
    """Request messages of reviews, some of them broken in one way or another."""
    number = F.col("id")
    shape = F.to_json(F.struct(
        F.when(number % 11 == 0, "review.asked").otherwise("review.requested").alias("type"), F.col("installation_id").alias("installationId"),
        F.when(number % 7 == 0, F.lit("nameless")).otherwise(F.col("repo_full_name")).alias("repoFullName"), F.when(number % 6 == 0, F.lit(0)).otherwise(F.col("pr_number")).alias("prNumber"),
        F.when(number % 5 == 0, F.upper("head_sha")).otherwise(F.col("head_sha")).alias("headSha"), F.when(number % 4 == 0, "timer").otherwise("manual").alias("trigger"),
    ))
    raw = m("reviews").select("id", F.when(number % 13 == 0, F.substring(shape, 1, 20)).otherwise(shape).alias("value"))
    return events.parse_events(raw, "review.requested").select("id", "reason")


@query
def instructions_for(m, table):
    rules = F.array(
        F.struct(F.lit("src/auth/**").alias("path"), F.lit("be careful").alias("instructions")), F.struct(F.lit("*.py").alias("path"), F.lit("type it").alias("instructions")),
        F.struct(F.lit("lib/*/f?.{ts,png}").alias("path"), F.lit("small").alias("instructions")), F.struct(F.lit("**/*.test.ts").alias("path"), F.lit("name cases").alias("instructions")),
    )
    files = m("files").withColumn("review_id", F.expr("cast(ord div 20 as bigint)"))
    policies = files.select("review_id").distinct().withColumn("path_instructions", F.when(F.col("review_id") % 3 == 0, F.reverse(rules)).otherwise(rules))
    return scoring.instructions_for(files, policies).select("review_id", "place", "path", "instructions", F.md5(F.array_join("files", ",")).alias("files_md5"), F.size("files").alias("n"))


@query
def extracted_imports(m, table):
    """Specifiers in scripts made of each document's number: every form, in code and in comments."""
    number = F.col("ord").cast("string")
    lines = F.array(
        F.concat(F.lit('import a from "./a'), number, F.lit('";')), F.lit('import "side";'), F.concat(F.lit("const b = require('../b"), number, F.lit("')")), F.lit('  // import c from "./gone"'),
        F.concat(F.lit("export * from '@/d"), F.lit("'")), F.lit('const e = await import("./lazy");'), F.lit("const f = from + imports;"),
    )
    kept = F.filter(lines, lambda line, i: (i + F.col("ord")) % 3 != 0)
    files = m("files").select(F.col("review_id").alias("repository_id"), F.col("filename").alias("path"), F.array_join(kept, "\n").alias("content"))
    return index.extract_imports(files).select("repository_id", "from_path", "spec")


@query
def alias_tables(m, table):
    """Aliases of repositories whose configurations have comments, bases, or none of their own."""
    number = F.col("github_repo_id")
    config = F.concat(
        F.lit('{ /* own */ "compilerOptions": {'), F.when(number % 2 == 0, F.concat(F.lit('"baseUrl": "./pkg'), (number % 5).cast("string"), F.lit('", '))).otherwise(""),
        F.lit('"paths": {"@/*": ["src/*"], "one": ["x"], "lib/*": ["./lib'), (number % 7).cast("string"), F.lit('/*", "other/*"]} } // end\n}'),
    )
    aliases = index.alias_prefixes(F.when(number % 3 != 0, config))
    return m("repositories").select("github_repo_id", F.array_join(F.transform(aliases, lambda a: F.concat(a["key"], F.lit("="), a["value"])), ",").alias("aliases"))


@query
def callers(m, table):
    """Uses of each review's functions in its own scripts, which call those of other files."""
    own = sources(m).filter(paths.ts_like(F.col("path"))).withColumn("review_id", F.expr("cast(ord div 20 as bigint)"))
    use = lambda line, i: F.when(i % 4 == 1, F.concat(F.lit("  x = fn"), (F.col("ord") + 3).cast("string"), F.lit("_"), (i - 1).cast("string"), F.lit("(1);"))).otherwise(line)
    files = own.withColumn("content", F.array_join(F.transform(F.split("content", "\n", -1), use), "\n"))
    symbols = index.declarations(own.filter("ord % 6 = 1")).select("review_id", "symbol")
    return graph.find_callers(symbols, files).select("review_id", "place", "symbol", "path", "line", F.size(F.split("snippet", "\n", -1)).alias("n_lines"))


@query
def summary_texts(m, table):
    found = m("review_findings")
    counts = scoring.severity_summary(found).select("review_id", F.col("summary").alias("counts"), F.expr("critical + high + medium + low").alias("n_findings"))
    reviews = counts.withColumns({
        "intent_summary": F.when(F.col("review_id") % 3 == 0, "Renames a thing."), "n_files": F.expr("cast(review_id % 7 as int)"), "level": F.when(F.col("review_id") % 2 == 0, "low").otherwise("high"),
        "factors": F.array(F.lit("first reason"), F.lit("second")), "n_rejected": F.col("review_id") % 4, "n_findings": F.when(F.col("review_id") % 5 == 0, 0).otherwise(F.col("n_findings")),
    })
    return render.review_summary_text(reviews).select("review_id", "summary")


@query
def check_texts(m, table):
    found = m("review_findings")
    base = scoring.overall_score(found).withColumns({"fail_on": F.array(F.lit("critical"), F.lit("high")), "min_score": F.lit(40), "warnings": F.when(F.col("review_id") % 9 == 0, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>"))})
    decided = scoring.policy_decision(found, base).withColumns({"level": F.lit("high"), "risk_score": F.lit(45), "factors": F.array(F.lit("a"), F.lit("b"))})
    return render.check_summary(decided).select("review_id", "conclusion", "check_title", "check_text")


@query
def eval_gate(m, table):
    """The odd reviews' evaluation against the even ones' as a baseline."""
    metrics = eval_metrics(m, table).withColumns({"tokens": F.lit(7).cast("long"), "error": F.lit(None).cast("string")})
    half = lambda odd: evals.eval_summary(metrics.filter(F.col("name") % 2 == odd))
    return evals.eval_gate(half(1), half(0))


@query
def route_reviews(m, table):
    return events.route_reviews(events.prefilter_events(m("webhook_events")).drop("github_repo_id")).select("event_id", "reason")


@query
def qualify_reviews(m, table):
    routed = events.route_reviews(events.prefilter_events(m("webhook_events")).drop("github_repo_id"))
    return events.qualify_review_requests(routed, m("repositories"), m("installations")).select("event_id", "skip")


@query
def route_index(m, table):
    return events.route_index(m("webhook_events").drop("github_repo_id")).select("event_id", "github_repo_id", "ref")


@query
def topic_keys(m, table):
    return m("reviews").select("id", topic_key("pr", F.col("repo_full_name"), F.col("pr_number")).alias("key"))


def updates(m) -> DataFrame:
    return m("webhook_events").select(F.col("github_repo_id").alias("review_id"), F.col("event_id").alias("seq"), F.col("received_at").alias("at"), "status")


@query
def progress_changes(m, table):
    changed = lifecycle.progress_changes(updates(m).withColumn("progress", F.lit(None).cast("string")))
    return changed.select(F.col("seq").alias("event_id"), "done")


@query
def lifecycle_progress(m, table):
    """Reviews' states from updates with steps, errors and times."""
    step = F.get(F.array(*map(F.lit, ["quality", "security", None, "done"])), (F.col("seq") % 4).cast("int"))
    error = F.when(F.col("seq") % 5 == 0, F.repeat(F.concat(F.lit("e"), F.col("seq").cast("string"), F.lit(" ")), 300))
    status = F.get(F.array(*map(F.lit, ["in_progress", "completed", "failed"])), (F.col("seq") % 3).cast("int"))
    state = lifecycle.lifecycle(updates(m).withColumns({"progress": step, "error": error, "status": status, "score": F.col("seq")}))
    return state.select("review_id", "status", "progress", F.md5("error").alias("error_md5"), F.length("error").alias("error_length"), "duration_ms")


@query
def progress_steps(m, table):
    step = F.get(F.array(*map(F.lit, ["quality", "quality", None, "security"])), (F.col("seq") % 4).cast("int"))
    changed = lifecycle.progress_changes(updates(m).withColumns({"progress": step, "status": F.when(F.col("seq") % 97 == 0, "failed").otherwise("in_progress")}))
    return changed.select(F.col("seq").alias("event_id"), "status", "progress", "done")


@query
def lifecycle_states(m, table):
    return lifecycle.lifecycle(
        updates(m).withColumns({"progress": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "score": F.col("seq")})
    ).select("review_id", "status", F.col("score").alias("last_event"))


@query
def claim_reviews(m, table):
    asked = m("webhook_events").join(m("reviews"), F.col("github_repo_id") == F.col("id")).select("repo_full_name", "pr_number", "head_sha", "event_id", F.col("event_id").alias("seq"))
    return lifecycle.claim_reviews(asked, m("reviews")).select("event_id", "claimed")


@query
def registry_repositories(m, table):
    action = F.get_json_object("payload", "$.action")
    none = F.lit(None).cast("string")
    changes = m("webhook_events").select(
        "github_repo_id", F.lit(1).alias("installation_id"), F.col("received_at").alias("at"), F.col("event_id").alias("seq"), F.lit("o/r").alias("full_name"),
        F.lit(False).alias("private"), none.alias("html_url"), action.alias("language"), none.alias("description"), (action == "closed").alias("removed"),
    )
    return registry.registry_repositories(changes).select("github_repo_id", "language", "active")


@query
def eval_metrics(m, table):
    found = distinct_findings(m).withColumn("name", F.col("review_id"))
    expected = found.filter("ord % 3 = 0").withColumnRenamed("id", "eid")
    cases = expected.select("name").distinct()
    return evals.eval_case_metrics(cases, expected, found.filter("ord % 3 <> 0").withColumnRenamed("id", "fid"))


@query
def line_churn(m, table):
    turns = table("conversations").select("conv_id", "turn", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    before = turns.join(following, ["conv_id", "turn"], "left_semi").withColumn("turn", F.col("turn") + 1)
    return diff.line_churn(before, turns.join(before.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi"), "conv_id", "turn")


@query
def import_resolution(m, table):
    files = m("code_files")
    specs = files.select("repository_id", F.col("path").alias("from_path"), F.explode("imports").alias("to")).select(
        "repository_id", "from_path", F.regexp_replace("to", r"^src/(.*)\.ts$", "./$1.js").alias("spec")
    )
    return index.resolve_imports(specs.distinct(), files)


@query
def finding_comments(m, table):
    suggestion = F.when(F.col("ord") % 3 == 0, "call(x);").when(F.col("ord") % 3 == 1, "use a name")
    return m("review_findings").withColumn("suggestion", suggestion).select("id", F.md5(render.finding_comment()).alias("comment_md5"))


@query
def token_usage(m, table):
    return scoring.token_usage(m("review_findings").withColumn("tokens", F.when(F.col("ord") != 4, F.col("ord") * 10)))


@query
def reviewer_status(m, table):
    calls = m("review_findings").filter("source <> 'eslint'").groupBy("review_id", "reviewer").agg((F.max("ord") < 6).alias("ok"))
    out = scoring.reviewer_status(calls)
    return out.select("review_id", F.array_join("failed_reviewers", ",").alias("failed"), F.array_join("skills", ",").alias("skills"), "all_failed")


@query
def scan_tree(m, table):
    listing = m("files").select(F.col("review_id").alias("repository_id"), "ord", F.lit("blob").alias("type"), F.col("filename").alias("path"), F.sha1("filename").alias("sha"), F.length("content").alias("size"))
    return scanned(listing).select("repository_id", "path")


@query
def embedding_texts(m, table):
    symbol = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("f"), F.col("ord").cast("string")))
    return m("files").select("ord", F.md5(text.embedding_text(F.col("filename"), symbol, F.col("content"))).alias("text_md5"))


@query
def line_contexts(m, table):
    return m("files").select("ord", F.md5(text.line_context(F.col("content"), F.lit(2), 1, marked=True)).alias("context_md5"))


@query
def max_fan_in(m, table):
    return graph.max_fan_in(changed_files(m), m("code_files"))


@query
def registry_installations(m, table):
    action = F.when(F.col("event_id") % 5 == 0, "deleted").when(F.col("event_id") % 5 == 1, "suspend").otherwise("created")
    owner = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), F.col("event_id").cast("string")))
    changes = m("webhook_events").select(
        F.col("github_repo_id").alias("installation_id"), F.col("received_at").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), "delivery_id", owner.alias("owner_user_id")
    )
    return registry.registry_installations(changes.withColumnRenamed("delivery_id", "account_login"))


@query
def save_findings(m, table):
    stored = distinct_findings(m)
    new = stored.filter("severity = 'critical'")
    return lifecycle.save_findings(stored, new).groupBy("review_id").agg(F.count("*").alias("n"))


@query
def repost_findings(m, table):
    reviews = m("reviews").withColumns({"base_sha": F.when(F.col("id") % 6 != 0, F.lit("base")), "reviewed_from_sha": F.when(F.col("id") % 5 == 0, F.lit("from"))})
    return lifecycle.repost_findings(reviews, m("review_findings")).groupBy("review_id", "from_sha").agg(F.count("*").alias("n"))


@query
def reposted_inline(m, table):
    """Findings to post again, told apart by whether the diff that they are posted on shows their line."""
    reviews = m("reviews").withColumns({"base_sha": F.lit("base"), "reviewed_from_sha": F.when(F.col("id") % 5 == 0, F.lit("from"))})
    found = lifecycle.repost_findings(reviews, distinct_findings(m))
    shown = distinct_findings(m).filter("file is not null and line % 4 <> 0").select("review_id", "file", "line")
    return findings.split_inline(found, shown).select("review_id", "id", "from_sha", "inline")


@query
def request_manual(m, table):
    asked = m("reviews").select("repo_full_name", "pr_number", "head_sha", F.col("id").alias("seq"))
    _, publish = lifecycle.request_manual(asked, m("reviews").filter("attempts > 0"))
    return publish.select("repo_full_name", "pr_number", "head_sha")


@query
def eval_summary(m, table):
    return evals.eval_summary(eval_metrics(m, table).withColumns({"tokens": F.lit(7).cast("long"), "error": F.when(F.col("name") % 10 == 0, F.lit("x"))}))


@query
def progress_labels(m, table):
    nodes = F.array(*map(F.lit, [*text.PROGRESS_LABELS, "other", ""]))
    return m("reviews").select("id", text.progress_label(F.get(nodes, (F.col("id") % 34).cast("int"))).alias("label"))


@query
def age_buckets(m, table):
    now = F.timestamp_seconds(F.unix_timestamp("updated_at") - 100 + F.col("id") * 7919 % 4_000_000)
    return m("reviews").select("id", text.age_bucket(F.col("updated_at"), now).alias("age"))


@query
def qualify_index(m, table):
    routed = events.route_index(m("webhook_events").drop("github_repo_id"))
    return events.qualify_index_requests(routed, m("repositories")).select("event_id", "repository_id", "full_name")


def sources(m) -> DataFrame:
    """Script files made of the documents' lines: a function around the second of every four, a comment for the last."""
    code = F.transform(
        F.split("content", "\n", -1),
        lambda line, i: F.when(i % 4 == 0, F.concat(F.lit("function fn"), F.col("ord").cast("string"), F.lit("_"), i.cast("string"), F.lit("() {")))
        .when(i % 4 == 1, F.concat(F.lit('  a = "'), F.md5(line), F.lit('";')))
        .when(i % 4 == 2, "}")
        .otherwise(F.concat(F.lit("// "), F.md5(line))),
    )
    return m("files").select("review_id", "ord", F.col("filename").alias("path"), F.array_join(code, "\n").alias("content"))


@query
def changed_symbols(m, table):
    lines = sources(m).select("review_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))
    added = lines.filter("i % 5 = 4").select("review_id", "path", (F.col("i") + 1).alias("line"))
    return index.changed_symbols(index.declarations(sources(m)), added)


@query
def chunked_declarations(m, table):
    files = sources(m).withColumnRenamed("review_id", "repository_id")
    return index.chunk_declarations(files).select("repository_id", "path", "symbol", "start_line", "end_line", F.md5("content").alias("content_md5"))


def policies(m) -> DataFrame:
    globs = F.when(F.col("review_id") % 3 == 0, F.array(F.lit("dist/**"), F.lit("*.png"))).when(F.col("review_id") % 3 == 1, F.array(F.lit("src/auth/**/*.ts")))
    return m("files").select("review_id").distinct().select("review_id", F.coalesce(globs, F.array().cast("array<string>")).alias("ignore"))


@query
def filter_ignored(m, table):
    return scoring.filter_ignored(m("files"), policies(m)).select("review_id", "filename")


def lint(m) -> DataFrame:
    rule = F.when(F.col("ord") % 4 == 0, "no-undef").when(F.col("ord") % 4 == 1, "eqeqeq").when(F.col("ord") % 4 == 2, "no-eval")
    return distinct_findings(m).withColumns({"rule_id": rule, "severity": F.when(F.col("category") == "style", 1).otherwise(2)})


@query
def lint_on_added_lines(m, table):
    files = distinct_findings(m).groupBy("review_id", F.col("file").alias("filename")).agg(F.min("id").alias("ord"))
    added = distinct_findings(m).filter("status = 'open'").select("review_id", "file", "line")
    return findings.lint_on_added_lines(lint(m), added, files.filter("filename is not null")).select("review_id", "id", "rule_id", "severity")


@query
def ground_findings(m, table):
    own = distinct_findings(m).withColumn("ord", F.struct("ord", "id"))
    prefix = F.when(F.col("line") % 3 == 0, "./").when(F.col("line") % 3 == 1, "b/").otherwise("")
    model_rows = own.filter("source = 'ai'").withColumns({"file": F.concat(prefix, "file"), "suggestion": F.lit(None).cast("string")})
    files = own.filter("status <> 'dismissed'").select("review_id", "file")
    lines = own.filter("category <> 'style'").select("review_id", "file", "line")
    errors = own.filter("source = 'eslint'").withColumns({"reviewer": F.lit("quality"), "rule_id": F.lit("eqeqeq"), "severity": F.when(F.col("verdict") == "confirmed", "error").otherwise("warning")})
    return findings.ground_findings(model_rows, files, lines, errors).select("review_id", "reviewer", "place", "file", "line", "severity", "message", "inline")


@query
def apply_verdicts(m, table):
    own = distinct_findings(m).drop("verdict").withColumn("ord", F.struct("ord", "id"))
    asked = findings.verify_batches(own, 2)
    said = F.when(F.col("category") == "bug", "rejected").when(F.col("category") == "style", "uncertain").otherwise("confirmed")
    answers = asked.filter("category <> 'performance'").select(
        "review_id", "batch", F.col("batch_id").alias("id"), F.lit(0).alias("ord"), said.alias("verdict"), (F.col("line") / 40).alias("confidence"), F.col("message").alias("reason")
    )
    failed = asked.filter("severity = 'critical'").select("review_id", "batch")
    return findings.apply_verdicts(own, answers, failed, 2).select("review_id", "id", "verdict", "confidence", "reason")


@query
def nearest_caller_files(m, table):
    return graph.nearest_caller_files(affected(m), 2).select("review_id", "path", "place")


@query
def order_affected(m, table):
    reached = graph.reached(changed_files(m), graph.reverse_edges(m("code_files")))
    return graph.order_affected(reached).select("review_id", "path", "place")


@query
def prioritise_sensitive(m, table):
    files = m("files").select("review_id", "filename", F.col("ord").alias("place"))
    return reports.prioritise_sensitive(files, paths.sensitive_path(F.col("filename"))).select("review_id", "filename", "new_place")


@query
def head_content_files(m, table):
    return diff.head_content_files(patches(m)).select("review_id", "filename", "place")


@query
def finding_list(m, table):
    return reports.finding_list(distinct_findings(m)).select("review_id", "id", "place")


@query
def union_reviewer_findings(m, table):
    own = distinct_findings(m).withColumn("reviewer", F.when(F.col("source") == "eslint", "quality").otherwise(F.col("reviewer")))
    grounded = own.withColumn("place", F.struct("ord", "id")).drop("ord")
    failed = own.filter("severity = 'critical' and reviewer = 'testing'").select("review_id", "reviewer")
    return findings.union_reviewer_findings(grounded, failed).select("review_id", "id", "reviewer", "ord")


@query
def removed_paths(m, table):
    files = m("code_files")
    return index.removed_paths(files.filter(F.size("imports") > 1), files)


@query
def diff_line_sets(m, table):
    lines = diff.parse_patch(patches(m), "review_id", "ord")
    count = lambda df, name: df.groupBy("review_id", "ord").agg(F.count("*").alias(f"n_{name}"), F.sum("new_line").alias(f"sum_{name}"))
    return count(diff.commentable_lines(lines), "commentable").join(count(diff.added_lines(lines), "added"), ["review_id", "ord"], "left")


@query
def rag_query_texts(m, table):
    listed = patches(m).groupBy("review_id").agg(F.sort_array(F.collect_list(F.struct("ord", "filename", "patch"))).alias("fs"))
    return listed.select("review_id", F.md5(text.rag_query_text(F.col("fs"))).alias("text_md5"))


@query
def extract_json(m, table):
    number = F.col("id").cast("string")
    inner = F.concat(F.lit('{"a":'), number, F.lit("}"))
    reply = F.when(F.col("id") % 4 == 0, inner).when(F.col("id") % 4 == 1, F.concat(F.lit("Here: "), inner, F.lit(" as asked"))).when(F.col("id") % 4 == 2, number).otherwise(F.lit('{"a":'))
    return m("reviews").select("id", text.extract_json(reply).alias("json"))


@query
def validate_model_output(m, table):
    item = F.struct("file", "line", F.when(F.col("status") == "dismissed", "awful").otherwise(F.col("severity")).alias("severity"), "category", "message")
    answers = m("review_findings").select("id", F.concat(F.lit("Answer: "), F.to_json(F.struct(F.array(item).alias("findings")))).alias("text"))
    return findings.validate_model_output(answers, "reviewer").select("id", "error")


@query
def validated_answers(m, table):
    """Answers of the three other shapes, each with what is wrong with it: numbers as text, texts too long, values out of range."""
    number = F.col("id")
    some = lambda n, good, bad: F.when(number % n == 0, bad).otherwise(good)
    item = F.struct(
        some(11, F.lit("a.ts"), F.lit("")).alias("file"), some(7, F.lit("12"), F.lit("1.5")).alias("line"), F.lit("low").alias("severity"), F.lit("bug").alias("category"),
        F.lit("a message").alias("message"), F.repeat(F.lit("s"), some(13, F.lit(10), F.lit(2001))).alias("suggestion"),
    )
    intent = F.struct(
        some(5, F.lit("what it does"), F.lit("")).alias("summary"), F.lit("fix").alias("changeType"), some(6, F.lit(True), F.lit(None).cast("boolean")).alias("stated"),
        some(9, F.lit("aligned"), F.lit("sideways")).alias("alignment"), some(8, F.lit("9.5"), F.lit("11")).alias("alignmentScore"),
    )
    verdict = F.struct(some(4, F.lit("2"), F.lit("two")).alias("id"), some(7, F.lit("confirmed"), F.lit("maybe")).alias("verdict"), some(5, F.lit(0.5), F.lit(1.5)).alias("confidence"))
    answers = {
        "review": F.struct(F.lit("fine").alias("summary"), some(3, F.lit("88"), F.lit("101")).alias("score"), F.array_repeat(item, some(17, F.lit(2), F.lit(41))).alias("findings")),
        "intent": intent,
        "verdicts": F.when(number % 10 != 0, F.struct(F.array(verdict).alias("verdicts"))),
    }
    out = None
    for kind, answer in answers.items():
        text_ = F.when(number % 19 == 0, "no answer").otherwise(F.coalesce(F.to_json(answer), F.lit("{}")))
        judged = findings.validate_model_output(m("reviews").select("id", text_.alias("text")), kind).select("id", F.lit(kind).alias("kind"), "error")
        out = judged if out is None else out.unionByName(judged)
    return out


@query
def review_summaries(m, table):
    found = distinct_findings(m).withColumn("inline", F.coalesce(F.col("line") > 20, F.lit(False))).withColumn("ord", F.struct("ord", "id"))
    url = F.when(F.col("review_id") % 2 == 0, F.concat(F.lit("https://host.example/"), F.col("review_id").cast("string")))
    reviews = scoring.overall_score(found).withColumns({"summary": F.lit("What was found."), "details_url": url})
    return render.review_summary_markdown(reviews, found).select("review_id", F.md5("markdown").alias("markdown_md5"))


@query
def normalised_paths(m, table):
    name = F.concat(F.when(F.col("ord") % 4 == 0, " ./").when(F.col("ord") % 4 == 1, "a/").when(F.col("ord") % 4 == 2, "b/a/").otherwise(""), "filename")
    return m("files").select("ord", text.normalise_path(name).alias("path"))


@query
def deactivate_repositories(m, table):
    removed = m("webhook_events").filter("event_type = 'installation_repositories'").select("github_repo_id")
    return registry.deactivate_repositories(m("repositories"), removed).select("github_repo_id", "active")


@query
def deleted_installations(m, table):
    return registry.deleted_installations(m("repositories"), m("installations")).select("github_repo_id", "active")


@query
def refresh_index(m, table):
    stored = m("code_files").select("repository_id", "path", "blob_sha")
    tree = stored.filter("path not like '%3.ts'").select(
        "repository_id", "path", F.when(F.length("blob_sha") + F.length("path") > 51, "new").otherwise(F.col("blob_sha")).alias("sha"), F.lit("head").alias("target_sha"), F.lit(None).cast("string").alias("indexed_sha")
    )
    changes = index.detect_file_changes(tree, stored)
    files = tree.select("repository_id", "path", F.col("sha").alias("blob_sha"))
    chunks, files = index.refresh_index(changes, files.withColumn("start_line", F.lit(2)), files, stored.withColumn("start_line", F.lit(1)), stored)
    return files.join(chunks.select("repository_id", "path", "start_line"), ["repository_id", "path"]).select("repository_id", "path", "blob_sha", "start_line")


@query
def finding_statuses(m, table):
    found = distinct_findings(m)
    said = F.when(F.col("category") == "bug", "dismissed").when(F.col("category") == "style", "nonsense").otherwise("open")
    changes = found.select(
        F.when(F.col("category") == "security", F.col("review_id") + 1).otherwise(F.col("review_id")).alias("review_id"), "id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), said.alias("status")
    )
    later = changes.withColumn("status", F.when(F.col("seq") == 1, "resolved").otherwise(F.col("status")))
    return lifecycle.set_finding_status(found, later).select("review_id", "id", "status")


@query
def auto_reviews(m, table):
    changes = m("webhook_events").select("github_repo_id", F.col("event_id").alias("seq"), (F.col("status") == "published").alias("enabled"))
    return lifecycle.set_auto_review(m("repositories"), changes).select("github_repo_id", "auto_review_enabled")


@query
def claim_owner(m, table):
    own = m("installations").withColumn("owner_user_id", F.when(F.col("status") == "active", F.col("owner_user_id")))
    accounts = m("installations").filter("installation_id % 2 = 0").select(F.concat(F.lit("x"), F.col("installation_id").cast("string")).alias("user"), F.upper("account_login").alias("account"))
    return registry.claim_owner(own, accounts).select("installation_id", "owner_user_id")


@query
def distinct_symbols(m, table):
    symbols = index.declarations(sources(m)).select("review_id", "symbol")
    return index.distinct_symbols(symbols).select("review_id", F.size("symbols").alias("n"), F.md5(F.array_join("symbols", ",")).alias("symbols_md5"))


@query
def ingest_diff_files(m, table):
    raw = patches(m).withColumn("review_id", F.expr("review_id div 2"))
    return ingested(raw).select("review_id", "ord", "filename", "additions", "deletions")


@query
def decoded_blobs(m, table):
    plain = F.col("ord") % 3 == 0
    data = F.when(plain, F.col("content")).otherwise(F.base64(F.col("content").cast("binary")))
    whole = decode_blob(data, F.when(plain, "utf-8").otherwise("base64"), 4000)
    return m("files").select("ord", F.md5(whole).alias("content_md5"))


@query
def assurance_records(m, table):
    """Every review's decision with what led to it."""
    found = m("review_findings")
    base = scoring.overall_score(found).withColumns({"fail_on": F.array(F.lit("critical")), "min_score": F.lit(40), "warnings": F.array().cast("array<string>")})
    decided = base.select("review_id", "score").join(scoring.policy_decision(found, base), "review_id")
    none = lambda kind: F.lit(None).cast(kind)
    checked = scoring.verification_summary(found, found.limit(0).select("review_id", F.lit(0).alias("batch"))).withColumnRenamed("status", "verification_status")
    reviews = decided.join(checked, "review_id").withColumns({
        "n_files": F.lit(1), "level": F.lit("low"), "risk_score": F.lit(0), "factors": F.array(F.lit("small, isolated change")), "failed_reviewers": F.array().cast("array<string>"),
        "skills": F.array(F.lit("quality")), "intent_summary": none("string"), "change_type": none("string"), "stated": none("boolean"), "alignment": none("string"),
        "alignment_score": none("double"), "alignment_summary": none("string"),
    })
    dims = scoring.dimension_scores(found, base.select("review_id", F.array().cast("array<string>").alias("failed_reviewers")))
    record = render.assurance_record(render.recommendations(reviews), dims)
    get = lambda path: F.get_json_object("assurance", path)
    return record.select(
        "review_id", get("$.decision.verdict").alias("verdict"), get("$.scorecard.overall").cast("double").alias("overall"), get("$.verification.uncertain").cast("long").alias("uncertain"),
        get("$.recommendations[0]").alias("recommendation"), get("$.intent").alias("intent"),
    )


def repository_states(m, old: bool) -> tuple[DataFrame, DataFrame]:
    """(tree, blobs) of the code files at an older or at their newest commit: scripts that are import lines and one function."""
    keep = "path not like '%4.ts'" if old else "path not like '%3.ts'"
    note = F.when(F.col("number") % 7 == 0, F.lit("// old\n" if old else "// new\n")).otherwise("")
    line = lambda x: F.concat(F.lit('import x from "'), F.regexp_replace(x, r"^src/(.*)\.ts$", "./$1.js"), F.lit('";\n'))
    code = F.concat(note, F.array_join(F.transform("imports", line), ""), F.lit("export function f"), F.col("number").cast("string"), F.lit("() {\n  x();\n}\n"))
    files = m("code_files").filter(keep).withColumn("number", F.expr("try_cast(regexp_extract(path, '([0-9]+)', 1) as bigint)")).withColumn("content", code)
    files = files.withColumn("sha", F.sha1("content"))
    tree = files.select("repository_id", F.col("number").alias("ord"), F.lit("blob").alias("type"), "path", "sha", F.length("content").alias("size"))
    return tree, files.select("repository_id", "sha", "content", F.lit("utf-8").alias("encoding"))


@query
def index_steps(m, table):
    """An index of the older commits brought to the newest ones."""
    requests = lambda tree, sha: tree.select("repository_id").distinct().withColumn("target_sha", F.lit(sha))
    state = {}
    for old, sha in ((True, "v1"), (False, "v2")):
        tree, blobs = repository_states(m, old)
        stored = state or {name: tree.sparkSession.createDataFrame([], schema.format(id="bigint")) for name, (schema, _) in indexing.TABLES.items()}
        state = indexing.refreshed(requests(tree, sha), tree, blobs, stored["files"], stored["chunks"], stored["repositories"], dims=8)
        state = {name: settled(df, f"state-{name}") for name, df in state.items()}
    chunks = state["chunks"].groupBy("repository_id", "path").agg(
        F.count("*").alias("n_chunks"), F.max("symbol").alias("symbol"), F.max(F.when(F.col("symbol").isNotNull(), F.col("start_line"))).alias("start_line"), F.min("commit_sha").alias("commit_sha")
    )
    files = state["files"].join(chunks, ["repository_id", "path"]).join(state["repositories"], "repository_id")
    return files.select("repository_id", "path", "blob_sha", F.array_join("imports", ",").alias("imports"), "n_chunks", "symbol", "start_line", "commit_sha", "indexed_sha")
