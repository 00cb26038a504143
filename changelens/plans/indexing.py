"""The code index kept in step with repositories: from listings and contents to files, import edges and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import embedding_text
from changelens.operators import index, retrieval
from changelens.sources.buckets import Buckets
from changelens.sources.tables import decode_blob, scan_tree, settled

FILE = ["repository_id", "path"]
CONFIG = "tsconfig.json"
TABLES = {
    "files": ("repository_id {id}, path string, blob_sha string, imports array<string>, specs array<string>", 256),
    "chunks": (
        "id string, repository_id {id}, path string, symbol string, start_line int, end_line int, content string, embedding array<float>, commit_sha string", 256,
    ),
    "repositories": ("repository_id {id}, indexed_sha string, config_sha string", 16),
}


def refreshed(
    requests: DataFrame, tree: DataFrame, blobs: DataFrame, files: DataFrame, chunks: DataFrame, repositories: DataFrame, *, embedder=None, dims: int = 384
) -> dict[str, DataFrame]:
    """What the index of the requested repositories becomes: files, chunks, repositories; and changes, what made it so.

    requests(repository_id, target_sha): the commits to index. tree(repository_id, ord, type, path, sha, size): their whole
    listings. blobs(repository_id, sha, content, encoding): contents, of which only those of new or changed files and of
    changed configurations are read. files, chunks and repositories are the stored index of these repositories, as
    TABLES says, and come back whole.

    A repository that is at its target is left as it is. Of the others, new and changed files are cut into chunks, embedded,
    and their imports resolved; removed files go. A file that can't be read has a row without imports and no chunk, and
    isn't read again until it changes. Edges of unchanged files are resolved anew where a path that came or went
    could be what one of their specifiers means, or where the repository's aliases changed; this is an equi-join of the stored
    specifiers' bases with the few bases of those paths. So the index after any number of steps equals one built at once.
    """
    known = repositories.select("repository_id", "indexed_sha", "config_sha")
    asked = requests.groupBy("repository_id").agg(F.max("target_sha").alias("target_sha"))
    stale = settled(asked.join(known, "repository_id", "left").filter("not (target_sha <=> indexed_sha)"), "stale-repositories")
    ids = stale.select("repository_id")
    entries = tree.join(ids, "repository_id", "left_semi")
    listed = settled(scan_tree(entries).select(*FILE, "sha"), "listed-files")
    stored = files.join(ids, "repository_id", "left_semi")
    changes = settled(index.file_changes(listed, stored), "file-changes")

    text = decode_blob(F.col("content"), F.col("encoding"))
    wanted = changes.filter("change <> 'removed'").select(*FILE, "sha")
    contents = blobs.select("repository_id", "sha", text.alias("content")).dropDuplicates(["repository_id", "sha"])
    new = settled(wanted.join(contents, ["repository_id", "sha"], "left"), "new-contents")
    readable = new.filter("content is not null")

    configs = entries.filter((F.col("path") == CONFIG) & F.col("sha").isNotNull()).select("repository_id", F.col("sha").alias("new_config"))
    configs = stale.join(configs, "repository_id", "left").select("repository_id", "target_sha", "config_sha", "new_config", F.col("indexed_sha").isNotNull().alias("again"))
    texts = contents.select("repository_id", F.col("sha").alias("new_config"), "content")
    configs = settled(configs.join(texts, ["repository_id", "new_config"], "left").withColumn("aliases", index.alias_prefixes(F.col("content"))), "configs")

    moved = changes.filter("change in ('added', 'removed')").select(*FILE)
    unchanged = stored.join(changes.select(*FILE), FILE, "left_anti")
    specs = unchanged.select("repository_id", F.col("path").alias("from_path"), F.explode("specs").alias("spec"))
    aliases = configs.select("repository_id", "aliases")
    could = index.with_base(specs, aliases).select("repository_id", "from_path", "base")
    could = could.join(index.bases_of(moved), ["repository_id", "base"], "left_semi").select("repository_id", F.col("from_path").alias("path"))
    turned = configs.filter("again and not (config_sha <=> new_config)").select("repository_id")
    again = settled(could.unionByName(unchanged.join(turned, "repository_id", "left_semi").select(*FILE)).distinct(), "resolved-again")

    found = index.extract_imports(readable).groupBy("repository_id", F.col("from_path").alias("path")).agg(F.sort_array(F.collect_set("spec")).alias("specs"))
    none = F.array().cast("array<string>")
    rows = new.join(found, FILE, "left").select(*FILE, F.col("sha").alias("blob_sha"), F.when(F.col("content").isNotNull(), F.coalesce("specs", none)).alias("specs"))
    rows = settled(rows.unionByName(unchanged.join(again, FILE, "left_semi").select(*FILE, "blob_sha", "specs")), "files-to-resolve")
    asking = rows.select("repository_id", F.col("path").alias("from_path"), F.explode("specs").alias("spec"))
    edges = index.import_lists(index.resolve_imports(asking, listed, aliases))
    rows = rows.join(edges, FILE, "left").select(*FILE, "blob_sha", F.when(F.col("specs").isNotNull(), F.coalesce("imports", none)).alias("imports"), "specs")

    cut = index.chunk_declarations(readable.select(*FILE, "content"))
    told = cut.withColumn("text", embedding_text(F.col("path"), F.col("symbol"), F.col("content")))
    vectors = retrieval.embed(told, embedder, dims=dims).join(stale.select("repository_id", "target_sha"), "repository_id")
    name = F.md5(F.concat_ws("|", F.col("repository_id").cast("string"), "path", F.coalesce("symbol", F.lit("")), "start_line", "end_line", F.md5("content")))
    chunk_rows = vectors.select(name.alias("id"), *FILE, "symbol", "start_line", "end_line", "content", "embedding", F.col("target_sha").alias("commit_sha"))

    gone = changes.select(*FILE)
    after = lambda old, touched, fresh: old.join(touched, FILE, "left_anti").unionByName(fresh.select(*old.columns))
    at = configs.select("repository_id", F.col("target_sha").alias("indexed_sha"), F.col("new_config").alias("config_sha"))
    return {
        "files": after(files, gone.unionByName(again), rows),
        "chunks": after(chunks, gone, chunk_rows),
        "repositories": known.join(ids, "repository_id", "left_anti").unionByName(at),
        "changes": changes,
    }


def index_tables(path: str, id_type: str = "string", buckets: dict[str, int] | None = None) -> dict[str, Buckets]:
    """The stored index below path: each table in buckets of repositories."""
    return {
        name: Buckets(f"{path}/{name}", schema.format(id=id_type), ["repository_id"], (buckets or {}).get(name, n)) for name, (schema, n) in TABLES.items()
    }


def refresh_stored(tables: dict[str, Buckets], requests: DataFrame, tree: DataFrame, blobs: DataFrame, **options) -> int:
    """Brings the stored index to the requested commits and says how many repositories that were not there yet it met.

    Only buckets of stale repositories are read and rewritten. The repositories' commits are written last: a run that was
    cut short is done again as a whole. Where every repository is at its target, nothing is read beyond their commits and nothing written.
    """
    spark = requests.sparkSession
    known = tables["repositories"].read(spark)
    stale = settled(requests.join(known, "repository_id", "left").filter("not (target_sha <=> indexed_sha)").select("repository_id", "target_sha"), "requested")
    n = stale.select("repository_id").distinct().count()
    if n:
        touched = {name: table.touched(stale) for name, table in tables.items()}
        parts = {name: table.read(spark, touched[name]) for name, table in tables.items()}
        after = refreshed(stale, tree, blobs, parts["files"], parts["chunks"], parts["repositories"], **options)
        for name in TABLES:
            tables[name].rewrite(settled(after[name], f"index-{name}"), touched[name])
    return n
