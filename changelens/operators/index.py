"""Code index: what changed, chunks, import edges, and the tables after a refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.paths import collapse, ts_like
from changelens.functions.text import line_windows

# The order in which a stem's files are tried, and the aliases of a project that declares none.
EXTENSIONS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
INDEXES = ["/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
DEFAULT_ALIASES = {"@/": "src/", "~/": "src/"}

DECLARATION = (
    r"^(\s*)(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
    r"(?:function\s*\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)"
)
CALLABLE = (
    r"^\s*(?:(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class)\s+([A-Za-z_$][\w$]*)"
    r"|(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)[^=]*=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=]*=>|[A-Za-z_$][\w$]*\s*=>)"
    r"|(?:(?:public|private|protected|static|async|override|get|set)\s+)*([A-Za-z_$][\w$]*)\s*\([^)]*\)[^;{]*\{)"
)
NOT_NAMES = ["if", "for", "while", "switch", "catch", "return", "function", "constructor"]
# Names too common to look for.
GENERIC = ["get", "set", "run", "main", "default", "handler"]
IMPORTS = r"""(?:\bfrom\s*|\bimport\s*\(\s*|\brequire\s*\(\s*|^\s*import\s+|[;\n]\s*import\s+)["']([^"'\n]+)["']"""


def detect_file_changes(tree: DataFrame, code_files: DataFrame) -> DataFrame:
    """(repository_id, path, sha, change): added, changed or removed files; unchanged ones are left out.

    tree(repository_id, path, sha, target_sha, indexed_sha) lists repositories whole; one whose index is at its target
    is left out, and so is one that tree doesn't list.
    """
    stale = tree.filter(~F.col("target_sha").eqNullSafe(F.col("indexed_sha")))
    listed = stale.select("repository_id").distinct()
    return file_changes(stale, code_files.join(listed, "repository_id", "left_semi"))


def file_changes(listed: DataFrame, known: DataFrame) -> DataFrame:
    """(repository_id, path, sha, change) between listed(repository_id, path, sha) and known(repository_id, path, blob_sha)."""
    change = (
        F.when(F.col("sha").isNull(), "removed").when(F.col("blob_sha").isNull(), "added").when(F.col("sha") != F.col("blob_sha"), "changed")
    )
    return (
        listed.select("repository_id", "path", "sha")
        .join(known.select("repository_id", "path", "blob_sha"), ["repository_id", "path"], "full_outer")
        .withColumn("change", change)
        .filter("change is not null")
        .select("repository_id", "path", "sha", "change")
    )


def removed_paths(tree: DataFrame, code_files: DataFrame) -> DataFrame:
    return code_files.select("repository_id", "path").join(tree.select("repository_id", "path"), ["repository_id", "path"], "left_anti")


#: Comments, strings and templates as wholes, brackets, and line ends.
TOKENS = (
    r"(?s)/\*.*?(?:\*/|\z)|//[^\n]*+|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`|[{}()\[\]]|\n"
)
#: A line that goes on in the next one.
CONTINUES = r"(=|=>|,|&&|\|\||\?|:|\+|\.)\s*$"


def code_lines(files: DataFrame, *keys: str) -> DataFrame:
    """files(keys, content) as lines (keys, i, line, before, depth, inside, code).

    before and depth count the brackets that are open at a line's begin and end, those in comments, strings and
    templates left out; inside says that a line begins in one of them; code is the line without them. Both sums run inside a
    file's rows. Patterns that hold brackets or quotes, and templates in templates, are read as plain code.
    """
    file = Window.partitionBy(*keys).orderBy("at")
    tokens = files.select(*keys, F.posexplode(F.regexp_extract_all("content", F.lit(TOKENS), F.lit(0))).alias("at", "token"))
    ends = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    tokens = tokens.withColumn("ends", ends).withColumn("i", F.coalesce(F.sum("ends").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    step = F.when(F.col("token").isin("{", "(", "["), 1).when(F.col("token").isin("}", ")", "]"), -1).otherwise(0)
    long = (F.col("ends") > 0) & (F.col("token") != "\n")
    # A token over several lines marks those that begin in it.
    spread = F.explode(F.when(long, F.sequence(F.lit(0), F.col("ends"))).otherwise(F.array(F.lit(0))))
    marks = tokens.select(*keys, "i", step.alias("step"), spread.alias("k")).select(*keys, (F.col("i") + F.col("k")).cast("int").alias("i"), F.when(F.col("k") == 0, F.col("step")).otherwise(0).alias("step"), "k")
    by_line = marks.groupBy(*keys, "i").agg(F.sum("step").alias("step"), (F.max("k") > 0).alias("inside"))
    lines = files.select(*keys, F.posexplode(F.split("content", "\n", -1)).alias("i", "line")).join(by_line, [*keys, "i"], "left")
    depth = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy(*keys).orderBy("i"))
    bare = F.rtrim(F.regexp_replace("line", TOKENS.removesuffix(r"|[{}()\[\]]|\n"), ""))
    inside = F.coalesce("inside", F.lit(False))
    return (
        lines.withColumn("depth", depth)
        .withColumn("before", F.col("depth") - F.coalesce("step", F.lit(0)))
        .select(*keys, "i", "line", "before", "depth", inside.alias("inside"), F.when(inside, "").otherwise(bare).alias("code"))
    )


def spans(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, symbol, end) of code_lines with symbol where it is set: the line on which what begins at i is closed.

    That is the first line from i on that has no more brackets open than i began with, and neither ends in the middle of
    an expression nor stands before an opening brace. Lines meet by the number of brackets, so each is compared in the
    window of its own level only. What is never closed ends on its own line.
    """
    behind = Window.partitionBy(*keys).orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.trim("code") != "", F.startswith(F.ltrim("code"), F.lit("{"))), ignorenulls=True).over(behind)
    final = ~F.col("code").rlike(CONTINUES) & ~F.coalesce(following, F.lit(False))
    closing = lines.withColumn("final", final).filter("final")
    levels = F.explode(F.sequence(F.col("depth"), F.greatest("before", "depth")))
    closing = closing.select(*keys, levels.alias("level"), "i", F.lit(None).cast("string").alias("symbol"), F.lit(True).alias("closes"))
    begun = lines.filter("symbol is not null").select(*keys, F.col("before").alias("level"), "i", "symbol", F.lit(False).alias("closes"))
    level = Window.partitionBy(*keys, "level").orderBy("i").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    end = F.coalesce(F.min(F.when(F.col("closes"), F.col("i"))).over(level), F.col("i"))
    return closing.unionByName(begun).withColumn("end", end).filter("not closes").select(*keys, "i", "symbol", "end")


def chunk_declarations(files: DataFrame, *, longest: int = 150, shortest: int = 3) -> DataFrame:
    """(repository_id, path, symbol, start_line, end_line, content) of files(repository_id, path, content).

    In scripts, declarations outside all brackets are segments, from the comment lines right above them to where their
    brackets close, however they are indented; what stands between them, imports and loose statements, are segments
    without a name, which count from `shortest` lines on. Segments longer than `longest`, unnamed ones, other languages and
    files of no segment become line windows.
    """
    keys = ["repository_id", "path"]
    lines = code_lines(files.filter(ts_like(F.col("path"))), *keys)
    named = (F.col("before") == 0) & ~F.col("inside") & F.col("code").rlike(DECLARATION)
    lines = lines.withColumn("symbol", F.when(named, F.regexp_extract("code", DECLARATION, 2)))
    ends = spans(lines, *keys).select(*keys, "i", "end")
    by_file = Window.partitionBy(*keys).orderBy("i")
    comment = F.col("inside") | F.col("line").rlike(r"^\s*(/\*|\*|//)")
    marked = lines.join(ends, [*keys, "i"], "left").withColumn("comment", comment & F.col("symbol").isNull())
    # A comment block belongs to the declaration that follows it at once.
    behind = by_file.rowsBetween(1, Window.unboundedFollowing)
    after = F.first(F.when(~F.col("comment"), F.col("symbol").isNotNull()), ignorenulls=True).over(behind)
    held = F.coalesce(F.max("end").over(by_file) >= F.col("i"), F.lit(False))
    marked = marked.withColumn("held", held).withColumn("leads", ~F.col("held") & F.col("comment") & F.coalesce(after, F.lit(False)))
    begins = F.col("symbol").isNotNull() & ~F.coalesce(F.max("end").over(by_file.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("i"), F.lit(False))
    lead_before = F.coalesce(F.lag("leads").over(by_file), F.lit(False))
    opens = (F.col("leads") | begins) & ~lead_before
    kind = F.when(F.col("held") | F.col("leads"), "named").when(F.trim("line") != "", "loose")
    marked = marked.withColumns({"opens": opens, "kind": kind})
    last = F.last("kind", ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    turns = (F.col("kind") == "loose") & F.coalesce(last == "named", F.lit(False))
    segments = marked.withColumn("segment", F.sum((F.col("opens") | F.coalesce(turns, F.lit(False))).cast("int")).over(by_file))
    grouped = (
        segments.groupBy(*keys, "segment")
        .agg(F.first("symbol", ignorenulls=True).alias("symbol"), F.sort_array(F.collect_list(F.struct("i", "line"))).alias("rows"))
        .withColumn("content", F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), r"\s+$", ""))
        .withColumn("skip", F.coalesce(F.length(F.regexp_extract("content", r"^((?:[ \t]*\n)*)", 1)), F.lit(0)))
        .withColumn("first", F.col("rows")[0]["i"] + 1 + F.length(F.regexp_replace(F.regexp_extract("content", r"^((?:[ \t]*\n)*)", 1), r"[^\n]", "")))
        .withColumn("content", F.expr("substring(content, skip + 1)"))
        .withColumn("n", F.size(F.split("content", "\n", -1)))
        .filter("content <> ''")
    )
    whole = F.array(F.struct(F.col("first").alias("start_line"), (F.col("first") + F.col("n") - 1).alias("end_line"), F.col("content").alias("content")))
    kept = grouped.filter(F.col("symbol").isNotNull() | (F.col("n") >= shortest)).withColumn(
        "pieces", F.when(F.col("symbol").isNotNull() & (F.col("n") <= longest), whole).otherwise(line_windows(F.col("content"), F.col("first")))
    )
    chunks = kept.select("repository_id", "path", "symbol", F.inline("pieces"))
    rest = files.join(kept.select("repository_id", "path").distinct(), ["repository_id", "path"], "left_anti")
    windows = rest.select("repository_id", "path", F.lit(None).cast("string").alias("symbol"), F.inline(line_windows(F.col("content"))))
    return chunks.unionByName(windows)


def declarations(files: DataFrame) -> DataFrame:
    """(review_id, path, symbol, start_line, end_line): functions, classes, methods and function-valued names at any depth.

    A declaration ends where the brackets that were open at its begin are all that is open again; see spans.
    """
    keys = ["review_id", "path"]
    lines = code_lines(files.filter(ts_like(F.col("path"))), *keys)
    names = [F.regexp_extract("code", CALLABLE, g) for g in (1, 2, 3)]
    symbol = F.when(names[0] != "", names[0]).when(names[1] != "", names[1]).when(names[2] != "", names[2])
    marked = lines.withColumn("symbol", F.when(~symbol.isin(NOT_NAMES) & ~F.col("inside"), symbol))
    return spans(marked, *keys).select(*keys, "symbol", (F.col("i") + 1).alias("start_line"), (F.col("end") + 1).alias("end_line"))


def changed_symbols(decls: DataFrame, added: DataFrame) -> DataFrame:
    """(review_id, path, symbol) of declarations that hold an added line(review_id, path, line); short and generic names are left out."""
    return (
        decls.join(added, ["review_id", "path"])
        .filter("line between start_line and end_line")
        .filter((F.length("symbol") >= 3) & ~F.col("symbol").isin(GENERIC))
        .select("review_id", "path", "symbol")
        .distinct()
    )


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """(review_id, symbols): the names that changed in a review's files, each once, sorted."""
    return symbols.groupBy("review_id").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def extract_imports(files: DataFrame) -> DataFrame:
    """(repository_id, from_path, spec) of import-from, export-from, require() and import() with a plain string."""
    code = F.regexp_replace("content", r"(?m)^\s*//.*$", "")
    specs = F.array_distinct(F.regexp_extract_all(code, F.lit("(?m)" + IMPORTS)))
    return files.select("repository_id", F.col("path").alias("from_path"), F.explode(specs).alias("spec"))


def alias_prefixes(config: Column, folder: str = "") -> Column:
    """Alias prefix to folder, an array of entries in declared order, from a config's compilerOptions; comments are allowed."""
    shape = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"
    options = F.from_json(config, shape, {"allowComments": "true", "allowTrailingComma": "true"})["compilerOptions"]
    base = F.concat(F.lit(folder + "/" if folder else ""), F.coalesce(options["baseUrl"], F.lit(".")), F.lit("/"))
    target = lambda e: collapse(F.concat(base, F.regexp_replace(F.get(e["value"], F.lit(0)), r"\*$", "")))
    starred = F.filter(F.map_entries(options["paths"]), lambda e: e["key"].endswith("/*") & F.coalesce(F.get(e["value"], F.lit(0)).endswith("/*"), F.lit(False)))
    found = F.transform(
        starred,
        lambda e: F.struct(
            F.regexp_replace(e["key"], r"\*$", "").alias("key"), F.when(target(e) == "", "").otherwise(F.concat(target(e), F.lit("/"))).alias("value")
        ),
    )
    default = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in DEFAULT_ALIASES.items()))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(default)


SCRIPT = r"\.(c|m)?js$"


def with_base(specs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """specs(repository_id, spec, from_path) with base, the path without ending that each means; those of packages are left out.

    aliases(repository_id, aliases) are entries as alias_prefixes gives them.
    """
    default = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in DEFAULT_ALIASES.items()))
    if aliases is None:
        specs = specs.withColumn("aliases", default)
    else:
        specs = specs.join(aliases, "repository_id", "left").withColumn("aliases", F.coalesce("aliases", default))
    folder = F.regexp_replace("from_path", r"[^/]*$", "")
    alias = F.get(F.filter("aliases", lambda a: F.startswith(F.col("spec"), a["key"])), F.lit(0))
    base = F.when(F.col("spec").rlike(r"^\.\.?/"), collapse(F.concat(folder, "spec"))).when(
        alias.isNotNull(), collapse(F.concat(alias["value"], F.expr("substring(spec, length(get(filter(aliases, a -> startswith(spec, a.key)), 0).key) + 1)")))
    )
    return specs.withColumn("base", base).filter("base is not null and base <> '' and not startswith(base, '..')").drop("aliases")


def bases_of(paths: DataFrame) -> DataFrame:
    """(repository_id, base, path): every base for which resolve_imports would try one of paths(repository_id, path)."""
    path = F.col("path")
    stems = F.array_compact(F.array(*(F.when(F.endswith(path, F.lit(t)), F.expr(f"substring(path, 1, length(path) - {len(t)})")) for t in [*EXTENSIONS, *INDEXES])))
    scripts = F.array(F.lit(".js"), F.lit(".mjs"), F.lit(".cjs"))

    def sources(stem):
        own = F.when(stem.rlike(r"\.(c|m)?ts$"), F.array(F.regexp_replace(stem, r"\.(c|m)?ts$", ".$1js"))).when(
            stem.rlike(r"\.tsx$"), F.transform(scripts, lambda s: F.concat(F.regexp_replace(stem, r"\.tsx$", ""), s))
        )
        return F.concat(F.array(stem), F.coalesce(own, F.array().cast("array<string>")))

    return paths.select("repository_id", F.explode(F.array_distinct(F.flatten(F.transform(stems, sources)))).alias("base"), "path")


def resolve_imports(specs: DataFrame, paths: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(repository_id, from_path, spec, path): the repository's file that each specifier means, none for packages.

    Every file that a specifier could mean is a candidate with its rank. Specifiers meet the repository's paths by the few
    bases that a path can stand for, which are fewer than a specifier's candidates; the least rank chooses.
    aliases(repository_id, aliases) are entries as alias_prefixes gives them.
    """
    b = F.col("base")
    stems = F.when(b.rlike(SCRIPT), F.array(b, F.regexp_replace(b, SCRIPT, ".$1ts"), F.regexp_replace(b, SCRIPT, ".tsx"))).otherwise(F.array(b))
    tails = F.array(*map(F.lit, [*EXTENSIONS, *INDEXES]))
    candidates = F.flatten(F.transform(stems, lambda s: F.transform(tails, lambda t: F.concat(s, t))))
    return (
        with_base(specs, aliases)
        .select("repository_id", "from_path", "spec", "base")
        .join(bases_of(paths), ["repository_id", "base"])
        .withColumn("rank", F.array_position(candidates, F.col("path")))
        .filter("rank > 0")
        .groupBy("repository_id", "from_path", "spec")
        .agg(F.min_by("path", "rank").alias("path"))
        .filter("path <> from_path")
    )


def import_lists(resolved: DataFrame) -> DataFrame:
    """(repository_id, path, imports): each file's distinct imports."""
    return resolved.groupBy("repository_id", F.col("from_path").alias("path")).agg(F.array_sort(F.collect_set("path")).alias("imports"))


def refresh_index(changes: DataFrame, chunks: DataFrame, files: DataFrame, stored_chunks: DataFrame, stored_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, files) of the index after changes: those of touched paths are replaced, of removed paths gone.

    Without changes both come back as they are, so a second run does nothing.
    """
    touched = changes.select("repository_id", "path")
    keys = ["repository_id", "path"]
    after = lambda stored, new: stored.join(touched, keys, "left_anti").unionByName(new.join(touched, keys, "left_semi").select(*stored.columns))
    return after(stored_chunks, chunks), after(stored_files, files)
