"""The code index: increments equal a rebuild, stored buckets, and late or repeated changes."""

import base64
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from changelens.operators import index
from changelens.plans import indexing
from changelens.sources.buckets import Buckets, Latest, merge

FILES, CHUNKS, REPOS = (schema.format(id="string") for schema, _ in indexing.TABLES.values())


def sha(text):
    return hashlib.sha1(text.encode()).hexdigest()


def frames(spark, target, listing):
    """requests, tree and blobs of {repository: {path: text}}."""
    tree, blobs = [], []
    for repo, files in listing.items():
        for ord_, (path, text) in enumerate(sorted(files.items())):
            tree.append((repo, ord_, "blob", path, sha(text), len(text)))
            plain = ord_ % 2 == 0
            blobs.append((repo, sha(text), text if plain else base64.encodebytes(text.encode()).decode(), "utf-8" if plain else "base64"))
    return (
        spark.createDataFrame([(repo, target) for repo in listing], "repository_id string, target_sha string"),
        spark.createDataFrame(tree, "repository_id string, ord int, type string, path string, sha string, size int"),
        spark.createDataFrame(sorted(set(blobs)), "repository_id string, sha string, content string, encoding string"),
    )


def listing(rng, binary=False):
    """Random repositories whose files import each other by name, folder and alias."""
    names = ["a", "b", "c", "d", "lib/a", "lib/index", "src/a", "src/b", "src/lib/index", "e.js"]
    out = {}
    for repo in ("r1", "r2"):
        files = {}
        for name in rng.sample(names, rng.randrange(3, len(names))):
            targets = rng.sample(["./a", "./b.js", "./lib", "../a", "@/a", "~/lib", "x:b", "./e", "react", "./c.mjs"], 4)
            path = name if name.endswith(".js") else name + rng.choice([".ts", ".tsx", ".mts"])
            files[path] = "".join(f'import x from "{t}";\n' for t in targets) + f"export function f{rng.randrange(3)}() {{\n  x();\n}}\n"
        files["notes.py"] = f"import os\n{rng.randrange(2)}\n"
        if binary:
            files["bin.ts"] = "\0"
        if rng.random() < 0.5:
            files["tsconfig.json"] = '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["lib/*"], /* own */ "x:*": ["./*"]}}}'
        out[repo] = files
    return out


def content(tables):
    key = lambda r: tuple(repr(x) for x in r)
    rows = lambda df, *columns: sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    return (
        rows(tables["files"], "repository_id", "path", "blob_sha", F.array_sort("imports"), F.array_sort("specs")),
        rows(tables["chunks"], "id", "repository_id", "path", "symbol", "start_line", "end_line", "content", F.hash("embedding")),
        rows(tables["repositories"], "repository_id", "indexed_sha", "config_sha"),
    )


def test_increments_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(11)
    steps = [listing(rng, binary=i == 1) for i in range(4)]
    steps[2].pop("r2")
    tables = indexing.index_tables(str(tmp_path / "index"), buckets={"files": 4, "chunks": 4, "repositories": 2})
    read = lambda: {name: table.read(spark) for name, table in tables.items()}
    for i, step in enumerate(steps):
        assert indexing.refresh_stored(tables, *frames(spark, f"sha{i}", step), dims=16) == len(step)
    last = {**steps[1], **steps[3]}
    nothing = [spark.createDataFrame([], s) for s in (FILES, CHUNKS, REPOS)]
    assert content(read()) == content(indexing.refreshed(*frames(spark, "sha3", last), *nothing, dims=16))
    # A second run writes nothing.
    seen = lambda: {p: p.stat().st_mtime_ns for p in Path(tmp_path / "index").rglob("*.parquet")}
    before = seen()
    assert indexing.refresh_stored(tables, *frames(spark, "sha3", steps[3]), dims=16) == 0 and seen() == before
    # A repository whose files are all gone leaves its bucket empty.
    requests, tree, blobs = frames(spark, "sha4", {"r1": {}, "r2": {}})
    assert indexing.refresh_stored(tables, requests, tree, blobs, dims=16) == 2
    assert [df.count() for df in read().values()] == [0, 0, 2]


def test_unchanged_importers_follow_what_comes_and_goes(spark):
    user = 'import a from "./a";\nimport b from "@/b";\n'
    nothing = [spark.createDataFrame([], s) for s in (FILES, CHUNKS, REPOS)]
    edges = lambda out: {r["path"]: r["imports"] for r in out["files"].collect()}
    first = indexing.refreshed(*frames(spark, "1", {"r": {"user.ts": user, "a/index.ts": "1"}}), *nothing, dims=8)
    assert edges(first)["user.ts"] == ["a/index.ts"]
    stored = lambda out: [out[name] for name in ("files", "chunks", "repositories")]
    second = indexing.refreshed(*frames(spark, "2", {"r": {"user.ts": user, "a/index.ts": "1", "a.ts": "2", "src/b.tsx": "3"}}), *stored(first), dims=8)
    assert edges(second)["user.ts"] == ["a.ts", "src/b.tsx"]
    assert {(r["path"], r["change"]) for r in second["changes"].collect()} == {("a.ts", "added"), ("src/b.tsx", "added")}
    config = '{"compilerOptions": {"paths": {"@/*": ["./*"]}}}'
    third = indexing.refreshed(*frames(spark, "3", {"r": {"user.ts": user, "a.ts": "2", "src/b.tsx": "3", "b.ts": "4", "tsconfig.json": config}}), *stored(second), dims=8)
    assert edges(third)["user.ts"] == ["a.ts", "b.ts"]


@pytest.mark.parametrize("path", ["a.ts", "a.tsx", "a.mts", "a.js", "lib/index.ts", "lib/index.tsx.ts", "x.js.ts", "a.cjs"])
def test_bases_are_those_that_resolve(spark, path):
    bases = {r["base"] for r in index.bases_of(spark.createDataFrame([("r", path)], "repository_id string, path string")).collect()}
    tried = ["a", "a.js", "a.mjs", "a.cjs", "a.ts", "a.tsx", "a.mts", "lib", "lib/index", "lib/index.js", "lib/index.ts", "lib/index.tsx", "lib/index.tsx.ts", "x.js", "x.ts", "x", "x.js.ts"]
    specs = spark.createDataFrame([("r", "zz.ts", "./" + t) for t in tried], "repository_id string, from_path string, spec string")
    hits = {r["spec"][2:] for r in index.resolve_imports(specs, spark.createDataFrame([("r", path)], "repository_id string, path string")).collect()}
    assert hits == bases & set(tried)


RULE = Latest(["id"], ["at", "seq"], last=["status"], known=["url"], first=["owner"])
CHANGE = "id long, at timestamp, seq long, status string, url string, owner string"


def plain_latest(changes):
    out = {}
    for c in sorted(changes, key=lambda c: (c[1], c[2])):
        old = out.get(c[0], (None, None, None))
        out[c[0]] = (c[3], c[4] if c[4] is not None else old[1], old[2] if old[2] is not None else c[5])
    return out


def test_states_do_not_hang_on_order_repeats_or_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    rng = random.Random(3)
    pick = lambda *x: rng.choice([None, *x])
    changes = [(rng.randrange(12), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(9)), i, pick("active", "deleted"), pick("u", "v"), pick("o", "p")) for i in range(90)]
    frame = lambda rows: spark.createDataFrame(rows, CHANGE)
    table = Buckets(str(tmp_path / "t"), RULE.schema(frame([])), ["id"], 4)
    shuffled = changes * 2
    rng.shuffle(shuffled)
    for i in range(0, len(shuffled), 45):
        merge(table, RULE, frame(shuffled[i : i + 45]))
    got = {r["id"]: (r["status"], r["url"], r["owner"]) for r in table.read(spark).collect()}
    assert got == plain_latest(changes)


def test_a_change_rewrites_its_bucket_only(spark, tmp_path):
    from datetime import datetime

    frame = lambda *ids: spark.createDataFrame([(i, datetime(2024, 1, 1), 1, "active", None, None) for i in ids], CHANGE)
    table = Buckets(str(tmp_path / "t"), RULE.schema(frame()), ["id"], 8)
    assert table.read(spark).isEmpty()
    merge(table, RULE, frame())
    assert not (tmp_path / "t").exists()
    merge(table, RULE, frame(*range(40)))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    (bucket,) = table.touched(frame(7))
    merge(table, RULE, frame(7))
    changed = {p.parent.name for p in before.keys() ^ files().keys()}
    assert changed == {f"_bucket={bucket}"} and table.read(spark).count() == 40
    assert len(files()) <= len(before)
    scan = table.read(spark, [bucket])._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in scan.split("PartitionFilters")[1]


def test_specifiers_are_not_repeated_for_their_candidates(spark):
    """Of a specifier's 13 or 39 candidates none is a row: paths meet it by the bases that they can stand for."""
    specs = spark.createDataFrame([(1, "src/a.ts", "./b.js"), (1, "src/a.ts", "./c")], "repository_id int, from_path string, spec string")
    paths = spark.createDataFrame([(1, "src/b.ts"), (1, "src/b.tsx"), (1, "src/c/index.ts"), (1, "src/c.js")], "repository_id int, path string")
    out = index.resolve_imports(specs, paths)
    assert sorted((r["spec"], r["path"]) for r in out.collect()) == [("./b.js", "src/b.ts"), ("./c", "src/c.js")]
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
