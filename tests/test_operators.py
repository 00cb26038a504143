"""Operators on small fixtures with known results."""

import datetime as dt

import random

import pytest
from pyspark.sql import functions as F

from changelens import queries
from changelens.functions import paths, text
from changelens.operators import diff, evals, events, findings, graph, index, lifecycle, registry, render, reports, retrieval, scoring
from changelens.sources import tables, topics

PATCH = """@@ -10,4 +10,5 @@ export function verify(token) {
   const header = decode(token);
-  const ALG = "RS256";
+  const ALG = process.env.JWT_ALG ?? "none";
+  log(ALG);
   return check(header, ALG);
 }
\\ No newline at end of file"""
FILES = "review_id long, ord int, filename string, status string, patch string, additions int, deletions int"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def value(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_patch_lines(spark):
    files = spark.createDataFrame([(1, 0, "a.ts", "modified", PATCH, 2, 1), (1, 1, "b.png", "modified", None, 0, 0)], FILES)
    lines = diff.parse_patch(files, "review_id", "filename")
    assert rows(lines.orderBy("i"), "i", "kind", "new_line") == [(1, " ", 10), (2, "-", None), (3, "+", 11), (4, "+", 12), (5, " ", 13), (6, " ", 14)]
    assert [r[0] for r in rows(diff.commentable_lines(lines), "new_line")] == [10, 11, 12, 13, 14]
    assert [r[0] for r in rows(diff.added_lines(lines), "new_line")] == [11, 12]
    numbered = diff.number_patch(lines, "review_id", "filename").first()["numbered"]
    assert '+   11 |   const ALG = process.env.JWT_ALG ?? "none";' in numbered and '-      |   const ALG = "RS256";' in numbered


def test_pack_diff(spark):
    big = "@@ -1,1 +1,400 @@\n" + "\n".join("+line of code" for _ in range(400))
    files = [
        (1, 0, "src/a.ts", "modified", PATCH, 2, 1), (1, 1, "pnpm-lock.yaml", "modified", PATCH, 2, 1), (1, 2, "img.png", "modified", None, 0, 0),
        (1, 3, "old.ts", "removed", PATCH, 0, 4), (2, 0, "big.ts", "modified", big, 400, 0), (2, 1, "small.ts", "modified", PATCH, 2, 1),
    ]
    out = {r["review_id"]: r for r in diff.pack_diff(spark.createDataFrame(files, FILES), 500).collect()}
    assert out[1]["included"] == ["src/a.ts"] and out[2]["included"] == ["small.ts"]
    assert [tuple(s) for s in out[1]["skipped"]] == [("pnpm-lock.yaml", "generated/vendored"), ("img.png", "binary or too large"), ("old.ts", "deleted")]
    assert [tuple(s) for s in out[2]["skipped"]] == [("big.ts", "over the token budget")]
    assert out[1]["text"].startswith('<file path="src/a.ts" status="modified">\n ')


def test_pack_diff_folds_sizes_and_gathers_what_fits(spark):
    files = [(1, i, f"src/f{i:03}.ts", "modified", "@@ -1,1 +1,2 @@\n" + "\n".join(["+line of code"] * (i % 7 + 1)), 1, 0) for i in range(400)]
    files += [(1, 400, "big.ts", "modified", "@@ -1,1 +1,400 @@\n" + "\n".join(["+x"] * 4000), 400, 0), (None, 0, "n.ts", "modified", PATCH, 2, 1)]
    packed = diff.pack_diff(spark.createDataFrame(files, FILES), 1000)
    out = {r["review_id"]: r for r in packed.collect()}
    numbered = {i: "\n".join(f"+{n + 1:5} | line of code" for n in range(i % 7 + 1)) for i in range(400)}
    blocks, used, included, over = [], 0, [], []
    for i in sorted(range(400), key=lambda i: (i % 7, i)):
        block = f'<file path="src/f{i:03}.ts" status="modified">\n{numbered[i]}\n</file>'
        fits = used + -(-len(block) // 4) <= 1000
        used += -(-len(block) // 4) if fits else 0
        blocks += [block] if fits else []
        (included if fits else over).append(f"src/f{i:03}.ts")
    assert out[1]["included"] == included and out[1]["text"] == "\n\n".join(blocks)
    assert [tuple(s) for s in out[1]["skipped"]] == [(name, "over the token budget") for name in [*over, "big.ts"]]
    assert out[None]["included"] == ["n.ts"]
    # neither the fold nor the texts' aggregate may see a block of a file that doesn't fit
    folded = [line for line in packed._jdf.queryExecution().optimizedPlan().toString().split("\n") if "aggregate(" in line]
    assert folded and not any("block" in line or "numbered" in line for line in folded)


def test_risk_inputs_gather_four_paths(spark):
    files = spark.createDataFrame([(1, i, f"src/auth/f{i:03}.ts", "modified", PATCH, 2, 1) for i in range(300)] + [(2, 0, "x.md", "modified", PATCH, 2, 1)], FILES)
    inputs = scoring.risk_inputs(files, files)
    got = {r["review_id"]: r["changed_paths"] for r in inputs.collect()}
    assert got == {1: [f"src/auth/f{i:03}.ts" for i in range(4)], 2: []}
    factors = {r["review_id"]: r["factors"] for r in scoring.assess_risk(inputs).collect()}
    assert "touches sensitive code: src/auth/f000.ts, src/auth/f001.ts, src/auth/f002.ts…" in factors[1]


def test_chunks(spark):
    code = """import { x } from "./x";

/** Checks a token. */
export function verifyJwt(token: string) {
  return x(token);
}

export class Session {
  id = 1;
}
export const isAdmin = (u) => u.admin;"""
    python = "\n".join(f"line {i}" for i in range(130))
    files = spark.createDataFrame([("r", "src/a.ts", code), ("r", "app.py", python)], "repository_id string, path string, content string")
    chunks = index.chunk_declarations(files)
    assert rows(chunks.filter("path = 'src/a.ts'"), "symbol", "start_line", "end_line") == [("Session", 8, 10), ("isAdmin", 11, 11), ("verifyJwt", 3, 6)]
    assert rows(chunks.filter("path = 'app.py'"), "start_line", "end_line") == [(1, 60), (51, 110), (101, 130)]


def test_changed_symbols_and_callers(spark):
    code = "export function verifyJwt(t) {\n  return t;\n}\n\nexport const other = () => 1;"
    files = spark.createDataFrame([(1, 0, "src/jwt.ts", code)], "review_id long, ord int, path string, content string")
    decls = index.declarations(files)
    added = lambda n: spark.createDataFrame([(1, "src/jwt.ts", n)], "review_id long, path string, line int")
    assert rows(index.changed_symbols(decls, added(2)), "symbol") == [("verifyJwt",)]
    assert rows(index.changed_symbols(decls, added(5)), "symbol") == [("other",)]
    caller = 'import { verifyJwt } from "./jwt";\n\nfunction login(req) {\n  const user = verifyJwt(req.token);\n  return user;\n}'
    callers = spark.createDataFrame([(1, 0, "src/login.ts", caller)], "review_id long, ord int, path string, content string")
    hits = graph.find_callers(index.changed_symbols(decls, added(2)), callers, radius=1)
    assert rows(hits, "symbol", "path", "line") == [("verifyJwt", "src/login.ts", 4)]
    assert hits.first()["snippet"] == "    3 | function login(req) {\n    4 |   const user = verifyJwt(req.token);\n    5 |   return user;"


def test_imports(spark):
    names = ["src/lib/jwt.ts", "src/lib/index.ts", "src/api/login.ts", "src/utils/x.tsx"]
    all_paths = spark.createDataFrame([("r", p) for p in names], "repository_id string, path string")
    content = 'import a from "../lib/jwt";\nexport * from "../lib";\nconst u = require("@/utils/x");\nconst j = await import("../lib/jwt.js");\nimport React from "react";\n'
    specs = index.extract_imports(spark.createDataFrame([("r", "src/api/login.ts", content)], "repository_id string, path string, content string"))
    assert {r[0] for r in rows(specs, "spec")} == {"../lib/jwt", "../lib", "@/utils/x", "../lib/jwt.js", "react"}
    found = dict(rows(index.resolve_imports(specs, all_paths), "spec", "path"))
    assert found == {"../lib/jwt": "src/lib/jwt.ts", "../lib": "src/lib/index.ts", "@/utils/x": "src/utils/x.tsx", "../lib/jwt.js": "src/lib/jwt.ts"}
    config = '{ // comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["./app/*"], "x": ["y"]}} }'
    assert [tuple(e) for e in value(spark, index.alias_prefixes(F.col("c")), c=config)] == [("@app/", "app/")]
    assert [tuple(e) for e in value(spark, index.alias_prefixes(F.col("c")), c="{}")] == [("@/", "src/"), ("~/", "src/")]


def test_blast_radius(spark):
    code = spark.createDataFrame([("r", "a.ts", ["b.ts"]), ("r", "b.ts", ["c.ts"]), ("r", "d.ts", ["c.ts"]), ("r", "c.ts", ["a.ts"])], "repository_id string, path string, imports array<string>")
    changed = lambda p: spark.createDataFrame([(1, "r", 0, p)], "review_id long, repository_id string, rank int, path string")
    edges = graph.reverse_edges(code.filter("path <> 'c.ts'"))
    assert rows(graph.blast_radius(changed("c.ts"), edges), "path", "distance", "via") == [("a.ts", 2, "c.ts"), ("b.ts", 1, "c.ts"), ("d.ts", 1, "c.ts")]
    assert rows(graph.blast_radius(changed("c.ts"), edges, 1), "path") == [("b.ts",), ("d.ts",)]
    assert rows(graph.blast_radius(changed("a.ts"), edges), "path") == []
    assert {r[0] for r in rows(graph.blast_radius(changed("a.ts"), graph.reverse_edges(code)), "path")} == {"b.ts", "c.ts", "d.ts"}


def test_blast_radius_equals_a_queue(spark):
    import random

    random.seed(4)
    n = 40
    imports = {i: sorted({random.randrange(n) for _ in range(random.randrange(4))}) for i in range(n)}
    code = spark.createDataFrame([("r", f"f{i}", [f"f{j}" for j in js]) for i, js in imports.items()], "repository_id string, path string, imports array<string>")
    order = [3, 17, 5]
    changed = spark.createDataFrame([(1, "r", k, f"f{c}") for k, c in enumerate(order)], "review_id long, repository_id string, rank int, path string")
    got = {r[0]: r[1:] for r in rows(graph.blast_radius(changed, graph.reverse_edges(code), 3), "path", "distance", "via")}
    distance, origin, level = {c: 0 for c in order}, {c: k for k, c in enumerate(order)}, list(order)
    for d in (1, 2, 3):
        nxt = {}
        for i, js in imports.items():
            for j in js:
                if j in level and i not in distance:
                    nxt[i] = min(nxt.get(i, 99), origin[j])
        for i, o in nxt.items():
            distance[i], origin[i] = d, o
        level = list(nxt)
    assert got == {f"f{i}": (d, f"f{order[origin[i]]}") for i, d in distance.items() if d}


def test_affected_files_are_walked_in_one_plan(spark):
    import os
    import random
    import re
    from urllib.parse import urlparse

    random.seed(9)
    code = [(r, f"f{i}", [f"f{random.randrange(30)}" for _ in range(random.randrange(4))]) for r in (1, 2) for i in range(30)]
    code += [(3, f"f{i}", ["hub", f"f{i}"]) for i in range(20)] + [(3, "hub", ["f0"]), (3, "top", ["f7"])]
    files = spark.createDataFrame(code, "repository_id long, path string, imports array<string>")
    # Review 4 has files of two repositories, one of them twice, and one that no file imports or is imported by.
    asked = [(1, 1, 0, "f3"), (1, 1, 1, "f9"), (2, 1, 0, "f9"), (3, 3, 0, "hub"), (4, 2, 2, "f1"), (4, 1, 0, "f4"), (4, 2, 1, "f1"), (4, 2, 3, "gone"), (5, 3, 1, "f0"), (5, 3, 0, "f7")]
    changed = spark.createDataFrame(asked, "review_id long, repository_id long, rank int, path string")
    folder = urlparse(spark.sparkContext.getCheckpointDir()).path
    before = len(os.listdir(folder))
    affected = graph.blast_radius(changed, graph.reverse_edges(files))
    plan = graph.order_affected(affected)._jdf.queryExecution().executedPlan().toString()
    assert len(os.listdir(folder)) == before  # nothing is written between levels
    assert "Broadcast" not in plan
    assert "Exchange" not in re.sub(r".*REPARTITION_BY_COL.*", "<dealt>", plan).split("<dealt>")[0]  # the rows of a review come together once
    expected = []
    for review in range(1, 6):
        distance = {(r, p): (0, min(k for v, q, k, o in asked if (v, q, o) == (review, r, p))) for v, r, _, p in asked if v == review}
        for level in (1, 2, 3):
            found = {}
            for r, importer, imports in code:
                for p in imports:
                    if distance.get((r, p), (9, 0))[0] == level - 1 and (r, importer) not in distance:
                        found[r, importer] = min(found.get((r, importer), (level, 99)), (level, distance[r, p][1]))
            distance |= found
        names = {k: p for v, _, k, p in asked if v == review}
        expected += [(review, p, d, names[k]) for (_, p), (d, k) in distance.items() if d]
    assert rows(affected, "review_id", "path", "distance", "via") == sorted(expected)
    assert {r[2] for r in expected} == {1, 2, 3}


FOUND = "review_id long, reviewer string, ord int, file string, line int, severity string, category string, message string, suggestion string"
LINT = "review_id long, reviewer string, ord int, file string, line int, rule_id string, message string, severity string"


def test_ground_findings(spark):
    found = spark.createDataFrame(
        [
            (1, "quality", 0, "src/auth.ts", 2, "low", "bug", "a real problem", None), (1, "quality", 1, "nope.ts", 2, "high", "bug", "unknown file", None),
            (1, "quality", 2, "./src/auth.ts", 3, "critical", "security", "another one", None), (1, "quality", 3, "src/auth.ts", 2, "low", "bug", "A REAL problem", None),
        ],
        FOUND,
    )
    files = spark.createDataFrame([(1, "src/auth.ts")], "review_id long, file string")
    lines = spark.createDataFrame([(1, "src/auth.ts", 3)], "review_id long, file string, line int")
    lint = spark.createDataFrame(
        [(1, "quality", 0, "src/auth.ts", 2, "no-eval", "m", "error"), (1, "quality", 1, "src/auth.ts", 7, "no-x", "n", "error"), (1, "quality", 2, "src/auth.ts", 8, "no-y", "o", "warning")], LINT
    )
    out = findings.ground_findings(found, files, lines, lint)
    assert [tuple(r) for r in out.orderBy("place").select("line", "severity", "source", "inline").collect()] == [
        (3, "critical", "ai", True), (7, "medium", "eslint", False), (2, "low", "ai", False),
    ]
    assert out.filter("line = 7").first()["message"] == "n (ESLint: no-x)"


@pytest.mark.parametrize(
    ("a", "b", "kept"),
    [
        (("critical", "security", 2, "missing await on call"), ("high", "security", 2, "other words"), ["critical"]),
        (("high", "bug", 2, "alpha beta gamma"), ("high", "security", 2, "delta epsilon zeta"), ["high", "high"]),
        (("high", "bug", 2, "missing await on call"), ("medium", "security", 2, "missing await here"), ["high"]),
        (("medium", "bug", 10, "promise never awaited here"), ("high", "bug", 11, "promise never awaited"), ["high"]),
        (("medium", "bug", 10, "promise never awaited"), ("high", "bug", 13, "promise never awaited"), ["high", "medium"]),
        (("medium", "bug", None, "no line"), ("low", "bug", None, "at all"), ["medium"]),
    ],
)
def test_dedupe(spark, a, b, kept):
    data = [(1, i, "f.ts", x[2], x[0], x[1], x[3]) for i, x in enumerate((a, b))]
    df = spark.createDataFrame(data, "review_id long, ord int, file string, line int, severity string, category string, message string")
    assert sorted(r["severity"] for r in findings.dedupe_findings(df).collect()) == sorted(kept)


def test_dedupe_equals_a_loop(spark):
    import random
    import re

    random.seed(1)
    words = "token check null await index value call loop error path".split()
    data = [
        (r, i, random.choice(["a.ts", "b.ts", None]), random.choice([None, 1, 2, 3, 9]), random.choice(findings.SEVERITIES), random.choice(findings.CATEGORIES), " ".join(random.choices(words, k=4)))
        for r in range(5)
        for i in range(30)
    ]
    df = spark.createDataFrame(data, "review_id long, ord int, file string, line int, severity string, category string, message string")
    kept = []
    word_set = lambda s: set(re.findall("[a-z0-9_]{3,}", s.lower()))
    for f in sorted(data, key=lambda d: (d[0], findings.SEVERITIES.index(d[4]), d[1])):
        for k in kept:
            if (k[0], k[2]) != (f[0], f[2]):
                continue
            gap, a, b = abs((k[3] or 0) - (f[3] or 0)), word_set(k[6]), word_set(f[6])
            alike = len(a & b) / len(a | b)
            if gap == 0 and (k[5] == f[5] or alike >= 0.2) or 0 < gap <= 2 and alike >= 0.35:
                break
        else:
            kept.append(f)
    assert rows(findings.dedupe_findings(df), "review_id", "ord") == sorted((k[0], k[1]) for k in kept)


def verified(spark, *verdicts):
    data = [(1, i, "f.ts", i + 1, "critical", "bug", "m", "quality", v) for i, v in enumerate(verdicts)]
    return spark.createDataFrame(data, "review_id long, ord int, file string, line int, severity string, category string, message string, reviewer string, verdict string")


def decide(spark, found, score, fail_on=("critical",), min_score=0, warnings=()):
    reviews = spark.createDataFrame([(1, score, list(fail_on), min_score, list(warnings))], "review_id long, score int, fail_on array<string>, min_score int, warnings array<string>")
    return scoring.policy_decision(found, reviews).first()


def test_scores_and_decisions(spark):
    confirmed, uncertain, none = verified(spark, "confirmed"), verified(spark, "uncertain"), verified(spark, "x").limit(0)
    assert scoring.overall_score(confirmed).first()["score"] == 70 and scoring.overall_score(uncertain).first()["score"] == 85
    blocked = decide(spark, confirmed, 70)
    assert (blocked["verdict"], blocked["conclusion"], blocked["reasons"]) == ("request_changes", "failure", ["critical bug finding at f.ts:1"])
    assert blocked["headline"] == "Blocked by policy: critical bug finding at f.ts:1"
    assert decide(spark, uncertain, 85)["conclusion"] == "success" and decide(spark, none, 100)["verdict"] == "approve"
    low = decide(spark, none, 60, min_score=70, warnings=["w"])
    assert low["reasons"] == ["score 60 is below min_score 70"] and [tuple(p) for p in low["policies"]][1:] == [("min_score", "fail", "score 60 vs minimum 70"), ("config_1", "warn", "w")]
    reviews = spark.createDataFrame([(1, ["security"])], "review_id long, failed_reviewers array<string>")
    assert dict((r[0], r[1]) for r in rows(scoring.dimension_scores(confirmed, reviews), "dimension", "score")) == {"quality": 7.0, "security": None, "testing": 10.0}


def test_verdicts(spark):
    found = findings.top_findings(verified(spark, *"abcd").withColumn("source", F.when(F.col("ord") == 3, "eslint").otherwise("ai")).drop("verdict"), 9).drop("place")
    verdicts = spark.createDataFrame(
        [(1, 0, 0, 0, "confirmed", 0.9, ""), (1, 0, 0, 1, "rejected", 0.9, "second answer"), (1, 0, 1, 2, "uncertain", 0.9, "")],
        "review_id long, batch int, id int, ord int, verdict string, confidence double, reason string",
    )
    failed = spark.createDataFrame([(1, 1)], "review_id long, batch int")
    out = findings.apply_verdicts(found, verdicts, failed, size=2)
    assert rows(out, "ord", "verdict", "confidence") == [(0, "confirmed", 0.9), (1, "uncertain", 0.6), (2, "uncertain", 0.5), (3, "confirmed", 0.8)]


def test_risk(spark):
    inputs = spark.createDataFrame(
        [(1, 37, 14, 1, 0, ["src/auth/jwt.ts"]), (2, 0, 0, 300, 0, ["scripts/x.ts"]), (3, 0, 0, 0, 0, [])],
        "review_id long, affected long, max_fan_in long, lines_changed long, deleted_tests long, changed_paths array<string>",
    )
    out = {r["review_id"]: r for r in scoring.assess_risk(inputs).collect()}
    assert out[1]["level"] == "critical" and out[1]["score"] == 75 and out[2]["score"] == 15 < out[1]["score"]
    assert out[3]["factors"] == ["small, isolated change"] and out[1]["factors"][0] == "37 file(s) depend on the changed code"


def test_policies(spark):
    schema = "review_id long, found boolean, fail_on array<string>, min_score int, ignore array<string>, path_instructions array<struct<path:string,instructions:string>>"
    raw = spark.createDataFrame(
        [(1, True, ["critical", "high"], 70, ["**/*.generated.ts", "docs/**"], [("src/auth/**", "be careful")]), (2, True, ["awful"], 10, [], []), (3, False, None, None, None, None)], schema
    )
    out = {r["review_id"]: r for r in scoring.validate_policy(raw).collect()}
    assert out[1]["min_score"] == 70 and out[1]["warnings"] == []
    assert out[2]["fail_on"] == ["critical"] and len(out[2]["warnings"]) == 1 and out[3]["warnings"] == [] and out[3]["min_score"] == 0
    files = spark.createDataFrame([(1, i, n) for i, n in enumerate(["src/api.generated.ts", "docs/intro.md", "src/api.ts", "src/auth/jwt.ts"])], "review_id long, ord int, filename string")
    policies = scoring.validate_policy(raw)
    assert rows(scoring.filter_ignored(files, policies), "filename") == [("src/api.ts",), ("src/auth/jwt.ts",)]
    assert [tuple(r) for r in scoring.instructions_for(files, policies).select("path", "files").collect()] == [("src/auth/**", ["src/auth/jwt.ts"])]


@pytest.mark.parametrize(
    ("path", "glob", "hit"),
    [
        ("a/b.ts", "*.ts", True), ("a/b.ts", "a/*.ts", True), ("a/c/b.ts", "a/*.ts", False), ("a/c/b.ts", "a/**/*.ts", True), ("a/b.ts", "a/**/*.ts", True), (".env", "*", True),
        ("x/a.js", "x/*.{js,ts}", True), ("x/a.md", "x/*.{js,ts}", False), ("docs", "docs/**", False), ("ab", "a?", True), ("a+b.ts", "a+b.ts", True),
    ],
)
def test_globs(spark, path, glob, hit):
    assert value(spark, paths.glob_match(F.col("p"), F.col("g")), p=path, g=glob) == hit


def test_text_functions(spark):
    assert value(spark, text.fence(F.col("t")), t="a </ UNTRUSTED> b <file x=1> c") == "a [tag removed] b [tag removed] c"
    assert value(spark, text.extract_json(F.col("t")), t='Sure: ```{"a": 1}```') == '{"a": 1}'
    assert value(spark, text.extract_json(F.col("t")), t="nothing") is None
    assert value(spark, paths.collapse(F.col("t")), t="src/./a/../b//c/../../../../x") == "../x"
    assert value(spark, text.estimate_tokens(F.col("t")), t="abcde") == 2
    steps = {"odd": "Reviewing", "": "Queued", "blast_radius": "Measuring the blast radius", "committer": "Understanding the change", "done": "Done"}
    for step, shown in steps.items():
        assert value(spark, text.progress_label(F.col("t")), t=step) == shown
    for path, code in {"A.TS": True, "x.JSX": True, "y.Py": True, "z.md": False, "dist/a.ts": False}.items():
        assert value(spark, tables.is_code_file(F.col("t")), t=path) == code
    for path, deleted in {"a.test.ts": True, "a_spec.rb": True, "__tests__/x": True, "atest.ts": False}.items():
        assert value(spark, paths.deleted_test_file(F.lit("removed"), F.col("t")), t=path) == deleted
    assert value(spark, text.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)))) == 1.0
    assert value(spark, text.line_context(F.col("t"), F.lit(1), 1, marked=True), t="a\nb\nc") == ">    1 | a\n     2 | b"
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    ages = {"2024-01-09 23:59:30": "just now", "2024-01-09 23:50:00": "10m ago", "2024-01-09 20:00:00": "4h ago", "2024-01-07 00:00:00": "3d ago", "2023-12-15 00:00:00": "26d ago", "2023-12-01 00:00:00": "Dec 1", "2024-01-11 00:00:00": "just now"}
    for at, shown in ages.items():
        assert value(spark, text.age_bucket(F.lit(at).cast("timestamp"), now)) == shown


EVENT = "key string, value string, topic string, `offset` long, ts timestamp"


def test_parse_events(spark):
    sha = "a" * 40
    good = f'{{"type":"review.requested","installationId":1,"repoFullName":"o/r","prNumber":7,"headSha":"{sha}","trigger":"webhook","requestedBy":null}}'
    raw = spark.createDataFrame([("k", good, "t", 0, None), ("k", "{oops", "t", 1, None), ("k", good.replace(sha, "abc"), "t", 2, None)], EVENT)
    out = [r["reason"] for r in events.parse_events(raw, "review.requested").orderBy("offset").collect()]
    assert out[0] is None and out[1] == "invalid JSON" and out[2].startswith("schema: headSha")
    letters = topics.dead_letter(raw.withColumn("reason", F.lit("x" * 2000))).first()
    assert letters["topic"] == "t.dlq" and [len(h["value"]) for h in letters["headers"]] == [1000, 1]
    assert value(spark, topics.topic_key("pr", F.lit("OctoCat/Hello"), F.lit(7))) == "octocat/hello#7"


def payload(**more):
    import json

    base = {"action": "opened", "number": 7, "installation": {"id": 1}, "repository": {"id": 3, "full_name": "o/r", "default_branch": "main"}}
    return json.dumps(base | {"pull_request": {"draft": False, "state": "open", "head": {"sha": "s"}}} | more)


def test_routing(spark):
    cases = [
        ("pull_request", payload(), None), ("pull_request", payload(action="closed"), "action closed"), ("push", payload(), "event push"),
        ("pull_request", payload(pull_request={"draft": True, "state": "open", "head": {"sha": "s"}}), "draft PR"),
        ("pull_request", payload(pull_request={"draft": False, "state": "closed", "head": {"sha": "s"}}), "PR not open"),
        ("pull_request", payload(number=None), "incomplete payload"), ("pull_request", payload(pull_request=None), "incomplete payload"),
    ]
    df = spark.createDataFrame([(i, k, p) for i, (k, p, _) in enumerate(cases)], "event_id int, event_type string, payload string")
    assert [r["reason"] for r in events.route_reviews(df).orderBy("event_id").collect()] == [c[2] for c in cases]
    index_cases = [
        ("installation", payload(action="created", repositories=[{"id": 1}, {"id": 2}]), [1, 2]), ("installation_repositories", payload(action="added", repositories_added=[{"id": 9}]), [9]),
        ("push", payload(ref="refs/heads/main", after="abc"), [3]), ("push", payload(ref="refs/heads/feature", after="abc"), []),
        ("push", payload(ref="refs/heads/main", after="000", deleted=True), []), ("push", payload(ref="refs/heads/main", after="0000"), []),
    ]
    df = spark.createDataFrame([(i, k, p) for i, (k, p, _) in enumerate(index_cases)], "event_id int, event_type string, payload string")
    got = rows(events.route_index(df), "event_id", "github_repo_id")
    assert got == [(i, r) for i, c in enumerate(index_cases) for r in c[2]]


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_registry(spark):
    schema = "installation_id long, at timestamp, seq long, action string, account_login string, owner_user_id string"
    data = [(1, at(1), 1, "created", "a", "u1"), (1, at(3), 3, "suspend", "b", "u2"), (1, at(2), 2, "unsuspend", "c", None), (2, at(1), 4, "deleted", "d", None)]
    expected = [(1, "suspended", "b", "u1"), (2, "deleted", "d", None)]
    for order in (data, data[::-1]):
        assert rows(registry.registry_installations(spark.createDataFrame(order, schema)), "installation_id", "status", "account_login", "owner_user_id") == expected
    stored = spark.createDataFrame([(1, "deleted", "old", "u0")], "installation_id long, status string, account_login string, owner_user_id string")
    assert registry.registry_installations(spark.createDataFrame(data, schema), stored).filter("installation_id = 1").first()["owner_user_id"] == "u0"
    owned = spark.createDataFrame([("u9", "D")], "user string, account string")
    claimed = registry.claim_owner(registry.registry_installations(spark.createDataFrame(data, schema)), owned)
    assert rows(claimed, "installation_id", "owner_user_id") == [(1, "u1"), (2, "u9")]
    repos = spark.createDataFrame([(1, True), (2, True)], "github_repo_id long, active boolean")
    assert rows(registry.deactivate_repositories(repos, repos.filter("github_repo_id = 2")), "github_repo_id", "active") == [(1, True), (2, False)]


def test_upsert_and_keyed_changes(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, n int")
    changes = spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string")
    assert rows(tables.upsert(table, changes, ["k"]), "k", "v", "n") == [(1, "a", 1), (2, "x", 2), (3, "y", None)]
    rule = {"v": F.coalesce("t.v", "c.v")}
    assert rows(tables.upsert(table, changes, ["k"], rule), "k", "v") == [(1, "a"), (2, "b"), (3, "y")]
    found = spark.createDataFrame([(1, "f1", "open"), (2, "f2", "open")], "review_id long, id string, status string")
    marks = spark.createDataFrame([(1, "f1", 1, "resolved"), (1, "f1", 2, "dismissed"), (1, "f2", 3, "resolved"), (2, "f2", 4, "odd")], "review_id long, id string, seq int, status string")
    assert rows(lifecycle.set_finding_status(found, marks), "id", "status") == [("f1", "dismissed"), ("f2", "open")]
    assert rows(lifecycle.save_findings(found, found.filter("id = 'f1'").withColumn("id", F.lit("n"))), "id") == [("f2",), ("n",)]


def test_manual_requests(spark):
    key = "repo_full_name string, pr_number int, head_sha string"
    reviews = spark.createDataFrame([("o/r", 1, "a", "completed"), ("o/r", 2, "b", "failed")], f"{key}, status string")
    asked = spark.createDataFrame([("o/r", 1, "a"), ("o/r", 2, "b"), ("o/r", 3, "c"), ("o/r", 3, "c")], key)
    new, publish = lifecycle.request_manual(asked, reviews)
    assert rows(new, "pr_number") == [(3,)] and rows(publish, "pr_number") == [(2,), (3,)]


def test_model_output(spark):
    ok = '{"findings": [{"file": "a.ts", "line": "3", "severity": "low", "category": "bug", "message": "five chars", "suggestion": null}]}'
    texts = [ok, "so: " + ok, ok.replace('"3"', "0"), ok.replace("low", "awful"), "none", '{"x": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = findings.validate_model_output(df, "reviewer").orderBy("id").collect()
    assert [r["error"] is None for r in out] == [True, True, False, False, False, False]
    verdicts = spark.createDataFrame([(0, '{"verdicts": [{"id": "1", "verdict": "confirmed", "confidence": "0.5"}]}'), (1, '{"verdicts": [{"id": 1, "verdict": "confirmed", "confidence": 2}]}')], "id int, text string")
    assert [r["error"] is None for r in findings.validate_model_output(verdicts, "verdicts").orderBy("id").collect()] == [True, False]


def test_evals(spark):
    expected = spark.createDataFrame([("c1", 1, "a.ts", 10), ("c1", 2, "a.ts", 40), ("c2", 3, "b.ts", 5)], "name string, eid int, file string, line int")
    found = spark.createDataFrame([("c1", 1, "a.ts", 13), ("c1", 2, "a.ts", 14), ("c1", 3, "a.ts", None), ("c3", 4, "x.ts", 1)], "name string, fid int, file string, line int")
    cases = spark.createDataFrame([("c1", 10, None), ("c2", 20, "boom"), ("c3", 5, None)], "name string, tokens long, error string")
    metrics = evals.eval_case_metrics(cases, expected, found)
    assert rows(metrics, "name", "expected", "found", "findings", "falsePositives") == [("c1", 2, 1, 3, 2), ("c2", 1, 0, 0, 0), ("c3", 0, 0, 1, 1)]
    summary = evals.eval_summary(metrics)
    assert tuple(summary.first()) == (0.33, 0.25, 3, 1, 35)
    baseline = spark.createDataFrame([(0.43, 0.3)], "recall double, precision double")
    assert tuple(evals.eval_gate(summary, baseline).first()) == (-0.1, -0.05, True)
    assert evals.eval_summary(metrics.limit(0)).first()["recall"] == 1.0


def most_rows(df):
    """The most rows that any node of df's executed plan gave."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
    return most


def test_eval_hits_grow_with_the_rows(spark):
    at = spark.range(2000).select(F.lit("c").alias("name"), "id", F.lit("a.ts").alias("file"), (F.col("id") % 60).cast("int").alias("line"))
    expected, found = at.filter("line < 40").withColumnRenamed("id", "eid"), at.filter("line > 20 and line % 9 = 0").withColumnRenamed("id", "fid")
    for df, flag in zip(evals.eval_hits(found, expected), ("found", "relevant"), strict=True):
        assert most_rows(df) <= 2000
        other = {27, 36, 45, 54} if flag == "found" else set(range(40))
        assert all(r[flag] == any(abs(r["line"] - x) <= 3 for x in other) for r in df.collect())


def test_eval_hits_judge_rows_by_their_own_place(spark):
    expected = spark.createDataFrame([("c", 1, "a.ts", 10), ("c", 1, "a.ts", 90), ("c", 2, None, 10), ("c", 3, "a.ts", None)], "name string, eid int, file string, line int")
    found = spark.createDataFrame([("c", 1, "a.ts", 13), ("c", 2, "a.ts", 6), ("c", 3, None, 10), ("d", 4, "a.ts", 10)], "name string, fid int, file string, line int")
    wanted, got = evals.eval_hits(found, expected)
    assert sorted(r["line"] for r in wanted.filter("found").collect()) == [10] and wanted.count() == 4
    assert [r["fid"] for r in got.filter("relevant").collect()] == [1] and got.count() == 4


def test_rendering(spark):
    row = spark.createDataFrame([("high", "bug", "msg", "x = 1;", "eslint")], "severity string, category string, message string, suggestion string, source string")
    assert row.select(render.finding_comment().alias("c")).first()["c"] == "🟠 **HIGH** · bug · ESLint\n\nmsg\n\n**Suggestion**\n```\nx = 1;\n```"
    ctx = "review_id long, reviewer string, rules array<struct<path:string,files:array<string>,instructions:string>>, callers array<struct<symbol:string,path:string,line:int,snippet:string>>, affected array<struct<path:string,distance:int,via:string>>, related array<struct<path:string,start_line:int,end_line:int,symbol:string,content:string>>"
    related = [("lib/a.ts", 1, 2, None, "x" * 400), ("src/auth/b.ts", 3, 4, "login", "short")]
    data = [(1, who, [("src/**", ["src/a.ts"], "rule")], [("f", "c.ts", 3, "y" * 4000)], [("d.ts", 1, "a.ts")], related) for who in ("quality", "security")]
    out = {r["reviewer"]: r["context"] for r in render.render_context(spark.createDataFrame(data, ctx), 100).collect()}
    assert "<team_rules>" in out["quality"] and "<callers" not in out["quality"] and "d.ts (distance 1, via a.ts)" in out["quality"]
    assert "<related_code" not in out["quality"] and 'symbol="login"' in out["security"]


def test_trend_and_pages(spark):
    reviews = spark.createDataFrame([(1, "completed", 85, at(1)), (2, "completed", 86, at(2)), (3, "completed", None, at(3)), (4, "failed", 1, at(4))], "id long, status string, score int, created_at timestamp")
    assert [tuple(r) for r in reports.score_trend(reviews).collect()] == [("2024-01-01", 8.6, 3)]
    assert [r["id"] for r in reports.page(reviews, [F.col("id")], 2, 3).collect()] == [4]
    series = reports.daily_series(reports.score_trend(reviews), "2024-01-02", 3)
    assert rows(series, "day", "reviews") == [("2023-12-31", 0), ("2024-01-01", 3), ("2024-01-02", 0)]


def test_embedding(spark):
    df = spark.createDataFrame([("the quick fox",), (None,)], "text string")
    vectors = [r["embedding"] for r in retrieval.embed(df, dims=16).collect()]
    assert abs(sum(x * x for x in vectors[0]) - 1) < 1e-6 and not any(vectors[1])


def test_sources(spark, tmp_path):
    schema = "repository_id string, ord int, type string, path string, sha string, size long"
    tree = spark.createDataFrame([("r", 0, "blob", "a.ts", "s", None), ("r", 1, "tree", "b.ts", "s", 1), ("r", 2, "blob", "dist/c.ts", "s", 1), ("r", 3, "blob", "d.PY", "s", 300_000), ("r", 4, "blob", "e.py", "s", 5)], schema)
    assert rows(tables.scan_tree(tree), "path") == [("a.ts",), ("e.py",)] and rows(tables.scan_tree(tree, most=1), "path") == [("a.ts",)]
    import base64

    blobs = spark.createDataFrame([("base64", base64.b64encode("hé".encode()).decode()), ("base64", base64.b64encode(b"a\0b").decode()), ("utf-8", "plain")], "e string, c string")
    assert [r["t"] for r in blobs.select(tables.decode_blob(F.col("c"), F.col("e")).alias("t")).collect()] == ["hé", None, "plain"]
    tables.write_table(spark.createDataFrame([("r", "a.ts", "s", ["b.ts"])], tables.SCHEMAS["code_files"]), str(tmp_path), "code_files")
    assert tables.read_table(spark, str(tmp_path), "code_files").first()["imports"] == ["b.ts"]


def test_installations_and_details(spark):
    schema = "installation_id long, login string, slug string, account_id long, type string, suspended_at timestamp, permissions string, events array<string>"
    raw = spark.createDataFrame([(1, None, "slug", 5, None, None, '{"a": "read", "b": 3, "c": null}', ["push"]), (2, None, None, 5, "User", at(1), "{}", [])], schema)
    out = {r["installation_id"]: r for r in reports.installation_row(raw).collect()}
    assert (out[1]["account_login"], out[1]["account_type"], out[1]["status"], out[1]["permissions"]) == ("slug", "Enterprise", "active", {"a": "read"})
    assert (out[2]["account_login"], out[2]["status"], out[2]["permissions"]) == ("5", "suspended", {})
    reviews = spark.createDataFrame([(1, None, "o/r", 7, 64), (2, "t", "o/r", 8, None)], "id long, pr_title string, repo_full_name string, pr_number int, score int")
    found = spark.createDataFrame([(1, 2, "b", "f", 1, "low", "bug", "m", "open"), (1, 1, "a", "f", 1, "low", "bug", "m", "open")], "review_id long, ord int, id string, file string, line int, severity string, category string, message string, status string")
    detail = {r["id"]: r for r in reports.review_detail(reviews, found).collect()}
    assert detail[1]["title"] == "o/r#7" and [i["id"] for i in detail[1]["issues"]] == ["a", "b"] and detail[2]["issues"] == [] and detail[1]["band"] == "fair"


def test_index_refresh(spark):
    files = spark.createDataFrame([("r", "a.ts", 1), ("r", "b.ts", 2), ("r", "c.ts", 3)], "repository_id string, path string, v int")
    new = spark.createDataFrame([("r", "a.ts", 10), ("r", "z.ts", 11)], "repository_id string, path string, v int")
    changes = spark.createDataFrame([("r", "a.ts", "changed"), ("r", "c.ts", "removed")], "repository_id string, path string, change string")
    chunks, after = index.refresh_index(changes, new, new, files, files)
    assert rows(after, "path", "v") == [("a.ts", 10), ("b.ts", 2)] and rows(chunks, "path") == [("a.ts",), ("b.ts",)]
    assert rows(index.refresh_index(changes.limit(0), new, new, files, files)[1], "path", "v") == rows(files, "path", "v")


def test_summaries(spark):
    schema = "review_id long, verdict string, conclusion string, headline string, reasons array<string>, policies array<struct<id:string,status:string,message:string>>, level string, risk_score int, factors array<string>, failed_reviewers array<string>, alignment string, intent_summary string, n_files int, n_findings int, counts string, n_rejected int, score int, details_url string, summary string"
    row = (1, "request_changes", "failure", "Blocked", ["a", "b", "c", "d"], [("x", "fail", "no")], "high", 50, ["f", "g", "h"], ["security"], "misaligned", None, 2, 3, "1 high", 1, 64, "http://x", "S")
    df = spark.createDataFrame([row], schema)
    assert render.recommendations(df).first()["recommendations"] == [
        "Fix before merging: a; b; c", "High-impact change (f; g): ask a second human reviewer.", "Re-run the review: the security reviewer(s) failed.",
        "The code doesn't match the PR description; update one of them.",
    ]
    assert render.review_summary_text(df).first()["summary"] == "Reviewed 2 file(s). Risk: high (f). Found 3 issue(s): 1 high. 1 possible issue(s) were checked and rejected."
    check = render.check_summary(df).first()
    assert check["check_title"] == "Blocked" and "(50/100): f; g; h" in check["check_text"]
    found = spark.createDataFrame([(1, 0, "high", "a.ts", 3, "m", True), (1, 1, "low", None, None, "off", False)], "review_id long, ord int, severity string, file string, line int, message string, inline boolean")
    markdown = render.review_summary_markdown(df, found).first()["markdown"]
    assert "6.4/10" in markdown and "🟠 1 high" in markdown and "- 🔵 `PR` off" in markdown and markdown.endswith("[Open the full review](http://x)")


def test_recovery(spark):
    schema = "id long, status string, attempts int, installation_id long, updated_at timestamp"
    reviews = spark.createDataFrame([(1, "pending", 3, None, at(0)), (2, "in_progress", 1, 5, at(1)), (3, "pending", 0, None, at(1)), (4, "pending", 0, 5, at(55)), (5, "completed", 0, 5, at(0))], schema)
    assert rows(lifecycle.sweep_stuck(reviews, "2024-01-01 01:00:00"), "id", "new_status", "new_attempts") == [(1, "failed", 3), (2, "pending", 2)]
    asked = spark.createDataFrame([("o/r", 1, "h", "base", "prev"), ("o/r", 2, "h", "base", None)], "repo_full_name string, pr_number int, head_sha string, base_sha string, previous_sha string")
    assert rows(lifecycle.diff_base(asked), "pr_number", "from_sha") == [(1, "prev"), (2, "base")]
    gone = spark.createDataFrame([("prev",)], "previous_sha string")
    assert rows(lifecycle.diff_base(asked, gone), "pr_number", "from_sha") == [(1, "base"), (2, "base")]
    events_ = spark.createDataFrame([("a", "received"), ("b", "received"), ("c", "failed")], "delivery_id string, status string")
    sent = spark.createDataFrame([("a", at(1)), ("c", at(1))], "delivery_id string, sent_at timestamp")
    assert rows(lifecycle.mark_published(events_, sent), "delivery_id", "status") == [("a", "published"), ("b", "received"), ("c", "failed")]


def test_a_sweep_stops_at_the_first_error(spark):
    events = spark.createDataFrame([(i, f"d{i}", "received", f"2024-01-01 00:00:{i:02}") for i in range(6)], "event_id long, delivery_id string, status string, received_at string")
    picked = lifecycle.sweep_outbox(events, "2024-01-02", most=5)
    errors = spark.createDataFrame([(3, "down"), (3, "broken"), (4, "down"), (9, "other")], "event_id long, error string")
    out = rows(lifecycle.sweep_results(picked, errors, "2024-01-02"), "event_id", "outcome", "new_status", "new_error")
    sent = [(i, "sent", "published", None) for i in range(3)]
    assert out == [*sent, (3, "failed", "received", "sweeper: broken"), (4, "untouched", "received", None)]
    every = lifecycle.sweep_results(picked, errors.limit(0), "2024-01-02")
    assert every.filter("outcome = 'sent'").count() == 5


CODE = """import { a } from "./a";

/* { not code
   function ghost() {
*/
  export function badly(x: string[]) {
if (x) { return "} not a bracket {"; }
        return `
function alsoGhost() {
`;
  }
export class Outer
{
    method(a, b) {
  const inner = (q) => {
      return q;
};
        return inner; // }
    }
    short() { return 1; }
}
const sum = (x) =>
  x +
  1;
run(); { }
export function many(
  a,
  b,
)
{
  return [a, b];
}
const one = () => 1; function tail() { return "'"; }
"""


def test_declarations_end_where_their_brackets_close(spark):
    files = spark.createDataFrame([(1, "r", "src/x.ts", CODE), (1, "r", "src/open.ts", "function open() {\n  a();")], "review_id long, repository_id string, path string, content string")
    got = rows(index.declarations(files).filter("path = 'src/x.ts'"), "symbol", "start_line", "end_line")
    assert got == [("Outer", 12, 21), ("badly", 6, 11), ("inner", 15, 17), ("many", 26, 32), ("method", 14, 19), ("one", 33, 33), ("short", 20, 20), ("sum", 22, 24)]
    assert rows(index.declarations(files).filter("path = 'src/open.ts'"), "symbol", "start_line", "end_line") == [("open", 1, 1)]
    added = spark.createDataFrame([(1, "src/x.ts", n) for n in (7, 16, 31)], "review_id long, path string, line int")
    assert rows(index.changed_symbols(index.declarations(files), added), "symbol") == [("Outer",), ("badly",), ("inner",), ("many",), ("method",)]


def test_chunks_follow_brackets_not_indents(spark):
    files = spark.createDataFrame([("r", "src/x.ts", CODE)], "repository_id string, path string, content string")
    got = {r["symbol"]: (r["start_line"], r["end_line"]) for r in index.chunk_declarations(files).collect()}
    assert got == {"badly": (3, 11), "Outer": (12, 21), "sum": (22, 24), "many": (26, 32), "one": (33, 33)}
    flat = "\n\n".join(f"let v{i} = {i};\ncall(v{i});\ncall();\nother();" for i in range(3))
    loose = index.chunk_declarations(spark.createDataFrame([("r", "src/y.ts", flat)], "repository_id string, path string, content string"))
    assert rows(loose.filter("symbol is null"), "start_line", "end_line") == [(2, 4), (7, 9), (12, 14)] and loose.filter("symbol is not null").count() == 3


def test_globs_meet_the_files_that_have_what_they_spell_out(spark):
    rng = random.Random(4)
    names = ["a.ts", "b.test.ts", "c.py", "Makefile", ".env", "d.min.js", "x.", "e"]
    paths_ = sorted({"/".join([*rng.choices(["src", "lib", "docs", "a.b", "src2"], k=rng.randrange(4)), rng.choice(names)]) for _ in range(150)})
    globs = ["*.ts", "**/*.ts", "src/**", "src/*", "src/**/*.test.ts", "Makefile", "src/Makefile", "*", "**", "?", ".env", "*.{js,ts}", "lib/*/a.ts", "**/docs/*", "a.b/**", "[a-c].*", "src/a.ts", "e", "x.", "*.", "src*/**", "docs"]
    files = spark.createDataFrame([(1, p) for p in paths_] + [(2, "src/a.ts")], "review_id long, filename string")
    asked = spark.createDataFrame([(1, g) for g in globs], "review_id long, glob string")
    got = rows(scoring.glob_hits(files, asked), "filename", "glob")
    pairs = spark.createDataFrame([(p, g) for p in paths_ for g in globs], "filename string, glob string")
    assert got == rows(pairs.filter(paths.glob_match(F.col("filename"), F.col("glob"))), "filename", "glob") and len(got) > 100
    meet = asked.withColumn("at", paths.glob_key(F.col("glob"))).join(files.withColumn("at", F.explode(paths.path_keys(F.col("filename")))), ["review_id", "at"])
    assert meet.count() < pairs.count() / 2  # a third of these globs spells out nothing


@pytest.mark.parametrize("name", ["finding_list", "dedupe_findings", "save_findings", "review_summaries", "union_reviewer_findings", "split_inline", "ground_findings"])
def test_findings_are_shuffled_by_review_alone(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert moved and all("hashpartitioning(l_orderkey" in line for line in moved)


def test_places_without_a_value_hold_no_row(spark):
    rows_ = spark.createDataFrame([(1, "a", 1), (1, "a", None), (1, None, 1), (2, "a", 1)], "review_id int, file string, line int")
    places = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "a", None), (1, None, 1)], "review_id int, file string, line int")
    out = findings.split_inline(rows_, places)
    assert sorted((r["review_id"], r["file"] or "", r["line"] or 0, r["inline"]) for r in out.collect()) == [(1, "", 1, False), (1, "a", 0, False), (1, "a", 1, True), (2, "a", 1, False)]


def test_an_answer_is_judged_once(spark):
    plan = queries.QUERIES["validate_model_output"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("exists(") == 1


@pytest.mark.parametrize("reply, found", [("null", "null"), (" 12 ", " 12 "), ('"x"', '"x"'), ("Answer: 12", None), ('Answer: {"a":1}', '{"a":1}'), ("nothing", None), ("\n[1]", "\n[1]")])
def test_bare_json_is_told_from_words(spark, reply, found):
    assert value(spark, text.extract_json(F.col("reply")), reply=reply) == found
