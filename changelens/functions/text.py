"""Column functions over text, arrays, JSON and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags that each kind of prompt fences off, and what a review's steps are called.
CONTEXT_TAGS = "untrusted|related_code|callers|affected_files|team_rules|diff|file|tool_findings"
REVIEW_TAGS = "untrusted|tool_findings|diff|file"
CLAIM_TAGS = "untrusted"
PROGRESS_LABELS = {
    "initialize_run": "Starting",
    "validate_event": "Starting",
    "snapshot_repository": "Reading the repository",
    "collect_pr_context": "Collecting the pull request",
    "collect_business_context": "Reading linked issues",
    "detect_technology": "Detecting the stack",
    "resolve_skills": "Choosing review checklists",
    "build_context_packs": "Gathering related code",
    "build_software_graph": "Mapping dependencies",
    "extract_business_intent": "Understanding the intent",
    "committer": "Understanding the change",
    "align": "Checking it matches the description",
    "volume": "Understanding the change",
    "cohesion": "Understanding the change",
    "blast_radius": "Measuring the blast radius",
    "criticality": "Assessing risk",
    "risk_assessment": "Assessing risk",
    "quality": "Reviewing code quality",
    "security": "Reviewing security",
    "testing": "Checking tests",
    "aggregate_findings": "Merging findings",
    "deduplicate_findings": "Merging findings",
    "verification_planner": "Verifying findings",
    "independent_verify": "Verifying findings",
    "scorecard": "Scoring",
    "policy_evaluation": "Applying policies",
    "assurance_decision": "Deciding",
    "generate_insights": "Writing the report",
    "publish_report": "Publishing",
    "done": "Done",
}


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def estimate_tokens(text: Column) -> Column:
    """About four characters make a token."""
    return F.ceil(F.length(text) / 4)


def normalise_path(path: Column) -> Column:
    return F.regexp_replace(F.trim(path), r"^(\./|a/|b/)", "")


def word_set(text: Column) -> Column:
    """The distinct words of three letters or more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]{3,})")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def fence(text: Column, tags: str = CONTEXT_TAGS) -> Column:
    """text with any of the tags, opening or closing, taken out."""
    return F.regexp_replace(text, rf"(?i)</?\s*({tags})[^>]*>", "[tag removed]")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null for a zero vector."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)


def embedding_text(path: Column, symbol: Column, content: Column, most: int = 2000) -> Column:
    header = F.concat(F.lit("// file: "), path, F.coalesce(F.concat(F.lit(" · "), symbol), F.lit("")))
    return F.substring(F.concat(header, F.lit("\n"), content), 1, most)


def line_windows(text: Column, start: Column | int = 1, size: int = 60, step: int = 50) -> Column:
    """Windows of `size` lines, each beginning `step` lines on; blank ones are left out.

    An array of (start_line, end_line, content), up to the first window that reaches the end.
    """
    first = F.lit(start) if isinstance(start, int) else start
    lines = F.split(text, "\n", -1)

    def cut(ls: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(ls) - size) / step).cast("int") * step), F.lit(step))
        windows = F.transform(
            starts,
            lambda i: F.struct(
                (first + i).cast("int").alias("start_line"),
                (first + F.least(i + size, F.size(ls)) - 1).cast("int").alias("end_line"),
                F.array_join(F.slice(ls, i + 1, size), "\n").alias("content"),
            ),
        )
        return F.filter(windows, lambda w: F.regexp_replace(w["content"], r"\s", "") != "")

    return let(lines, cut)


def numbered(lines: Column, start: Column, mark: Column | None = None) -> Column:
    """Lines behind their numbers; with mark, the marked line begins with '>' and others with a blank."""

    def row(text: Column, i: Column) -> Column:
        number = F.concat(F.lpad((start + i).cast("string"), 5, " "), F.lit(" | "), text)
        return number if mark is None else F.concat(F.when(start + i == mark, ">").otherwise(" "), number)

    return F.array_join(F.transform(lines, row), "\n")


def line_context(content: Column, at: Column, radius: int, marked: bool = False) -> Column:
    """The lines around line `at`, numbered, radius to each side as far as the file goes."""
    start = F.greatest(F.lit(1), at - radius)
    lines = F.split(content, "\n", -1)
    return numbered(F.slice(lines, start, at + radius - start + 1), start, at if marked else None)


def rag_query_text(files: Column, most: int = 2000) -> Column:
    """files(filename, patch): of each its name and added lines, one after the other."""
    added = lambda patch: F.array_join(F.filter(F.split(patch, "\n", -1), lambda line: line.startswith("+")), "\n")
    blocks = F.transform(files, lambda f: F.concat(F.lit("// file: "), f["filename"], F.lit("\n"), F.coalesce(added(f["patch"]), F.lit(""))))
    return F.substring(F.array_join(blocks, "\n"), 1, most)


def extract_json(text: Column) -> Column:
    """The JSON object in a reply, bare or inside other text; null if there is none."""
    # JSON begins with no letter but those of true, false and null; to find that out by parsing takes longest.
    whole = F.when(~text.rlike(r"^\s*[A-Za-z&&[^tfnNI]]") & F.try_parse_json(text).isNotNull(), text)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner))


def progress_label(node: Column) -> Column:
    """What a review's step is called; without a step it is queued, in an unknown one it is reviewing."""
    label = F.create_map(*(F.lit(x) for pair in PROGRESS_LABELS.items() for x in pair))[node]
    return F.when(F.coalesce(node, F.lit("")) == "", "Queued").otherwise(F.coalesce(label, F.lit("Reviewing")))


def age_bucket(at: Column, now: Column) -> Column:
    """just now, minutes, hours, days up to a month of 30, then month and day. What lies ahead is just now."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(at)
    unit = lambda n, name: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{name} ago"))
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, unit(60, "m"))
        .when(seconds < 86400, unit(3600, "h"))
        .when(seconds < 30 * 86400, unit(86400, "d"))
        .otherwise(F.date_format(at, "MMM d"))
    )


def ui_score(score: Column) -> Column:
    """0 to 100 as 0.0 to 10.0."""
    return F.round(score) / 10


def score_band(score: Column) -> Column:
    return F.when(ui_score(score) >= 8, "good").when(ui_score(score) >= 5, "fair").when(score.isNotNull(), "poor")


def clean_permissions(raw: Column) -> Column:
    """The entries of a JSON map whose values are strings."""
    values = F.map_filter(F.from_json(raw, "map<string,variant>"), lambda _, v: F.schema_of_variant(v) == "STRING")
    return F.transform_values(values, lambda _, v: v.cast("string"))
