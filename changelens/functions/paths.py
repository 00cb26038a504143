"""Column functions over file paths and globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that aren't reviewed, that are sensitive, and that hold tests.
SKIPPED = [
    r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|bun\.lockb|Cargo\.lock|poetry\.lock|go\.sum)$",
    r"\.min\.(js|css)$",
    r"(?i)\.(map|snap|svg|png|jpe?g|gif|webp|ico|pdf|zip|woff2?|ttf|eot|mp4|mp3)$",
    r"(^|/)(dist|build|out|coverage|node_modules|vendor|\.next)/",
    r"\.generated\.\w+$",
]
SENSITIVE = (
    r"(?i)(^|/)(auth|login|session|jwt|token|oauth|password|crypto|secret|payment|billing|checkout|permission|rbac|acl"
    r"|migrations?|security|middleware)[^/]*"
)
TESTS = r"(\.|_)(test|spec)\.|__tests__/"
TS_LIKE = r"\.(c|m)?(j|t)sx?$"


def skipped_path(path: Column) -> Column:
    out = path.rlike(SKIPPED[0])
    for pattern in SKIPPED[1:]:
        out |= path.rlike(pattern)
    return out


def sensitive_path(path: Column) -> Column:
    return path.rlike(SENSITIVE)


def deleted_test_file(status: Column, path: Column) -> Column:
    return (status == "removed") & path.rlike(TESTS)


def ts_like(path: Column) -> Column:
    return path.rlike(TS_LIKE)


def collapse(path: Column) -> Column:
    """A path without '.' and 'x/..' parts; leading '..' stay."""
    step = lambda done, part: (
        F.when((part == "") | (part == "."), done)
        .when((part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part)))
    )
    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(path, "/", -1), empty, lambda done, part: step(F.coalesce(done, empty), part)), "/")


def glob_pattern(glob: Column) -> Column:
    """A glob as a regular expression over whole paths: *, **, ?, {a,b} and [..]; dot files match.

    A glob without '/' is held against the last part of the path.
    """
    quoted = F.regexp_replace(glob, r"([.+^$()|\\])", r"\\$1")
    # Stand-ins keep the parts of a translated glob from being translated again.
    marks = [(r"\*\*/", "\x01"), (r"/\*\*$", "\x02"), (r"\*\*", "\x03"), (r"\*", "\x04"), (r"\?", "\x05")]
    for pattern, mark in marks:
        quoted = F.regexp_replace(quoted, pattern, mark)
    braces = F.transform(F.split(quoted, r"(?=[{},])|(?<=[{},])", -1), lambda x: F.when(x == "{", "(?:").when(x == "}", ")").when(x == ",", "|").otherwise(x))
    out = F.when(quoted.contains("{"), F.array_join(braces, "")).otherwise(quoted)
    for mark, regex in (("\x01", "(?:.*/)?"), ("\x02", "/.*"), ("\x03", ".*"), ("\x04", "[^/]*"), ("\x05", "[^/]")):
        out = F.regexp_replace(out, mark, regex)
    prefix = F.when(glob.contains("/"), F.lit("^")).otherwise(F.lit("^(?:.*/)?"))
    return F.concat(prefix, out, F.lit("$"))


def glob_match(path: Column, glob: Column) -> Column:
    return F.regexp_like(path, glob_pattern(glob))


def glob_key(glob: Column) -> Column:
    """(kind, key): something that every path which a glob matches has as one of its path_keys.

    The folder that a glob begins with (d), if it names one; else the last part's name (n), if it is without wildcards; else
    its ending (e); else every path's empty folder.
    """
    parts = F.split(glob, "/", -1)
    wild = lambda x: x.rlike(r"[*?{}\[\]]")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    first = F.array_min(F.transform(folders, lambda x, i: F.when(wild(x), i)))
    folder = F.array_join(F.slice(folders, 1, F.coalesce(first, F.size(folders))), "/")
    name = F.element_at(parts, -1)
    ending = F.regexp_extract(name, r"(\.[^.*?{}\[\]]+)$", 1)
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    return (
        F.when(folder != "", key("d", folder)).when(~wild(name) & (name != ""), key("n", name)).when(ending != "", key("e", ending)).otherwise(key("d", F.lit("")))
    )


def path_keys(path: Column) -> Column:
    """The (kind, key) pairs of a path: each folder above it, the empty one included, its name and its ending."""
    parts = F.split(path, "/", -1)
    name = F.element_at(parts, -1)
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: key("d", F.array_join(F.slice(parts, 1, i), "/")))
    own = F.array(key("n", name), key("e", F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    return F.array_distinct(F.concat(folders, own))
