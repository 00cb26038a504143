"""URL filters: dated list entries as validity intervals, and captures judged by those active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.scratch import written

#: Days in a time bucket of the interval join.
BUCKET_DAYS = 30
#: Intervals of up to so many bytes, spread over their buckets, are broadcast.
BROADCAST_BYTES = 32 << 20
#: Captures of one pattern and time bucket in a part, where intervals are joined by shuffling.
PART_ROWS = 100_000
#: Hot patterns of up to so many rows are broadcast.
BROADCAST_HOT = 100_000


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path without query and fragment; '/' where it is empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def entry_intervals(entries: DataFrame) -> DataFrame:
    """entries(kind, pattern, listed, verdict, at) as (kind, pattern, verdict, valid_from, valid_to).

    An entry holds from its date until the next entry of its pattern, valid_to being null for the last. An entry with
    listed false ends the one before it and opens none. Of entries with one date, the one with the greatest (listed,
    verdict) counts. Rows with a null pattern or date are left out.
    """
    dated = (
        entries.filter("pattern is not null and at is not null")
        .groupBy("kind", "pattern", "at")
        .agg(F.max(F.struct("listed", "verdict")).alias("last"))
    )
    later = Window.partitionBy("kind", "pattern").orderBy("at")
    return (
        dated.select("kind", "pattern", "last.*", F.col("at").alias("valid_from"), F.lead("at").over(later).alias("valid_to"))
        .filter("listed")
        .select("kind", "pattern", "verdict", "valid_from", "valid_to")
    )


def url_keys(url: Column) -> Column:
    """The (kind, pattern) pairs that may list a URL: its host, each domain above it, and each folder of its path."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    pair = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern"))
    keys = F.concat(
        F.array(pair("host")(host)), F.transform(domains, pair("domain")), F.transform(folders, pair("path"))
    )
    return F.when(host.isNotNull(), keys)


def active_entries(captures: DataFrame, intervals: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """(capture, kind, pattern, verdict) of every entry that is active when a capture is fetched.

    captures(capture, url, fetched_at). Captures and intervals meet by pattern and time bucket, an interval being in each
    bucket that it touches, so a capture sees only its pattern's entries of that month; the bounds decide. Buckets
    before the first capture and behind the last one are left out. A capture that is fetched at valid_from is inside, at valid_to outside.

    Intervals of up to broadcast_bytes are broadcast, so that no capture moves. More are joined by shuffling; a
    pattern's captures of a month, which can be nearly all, are counted first and dealt to parts of about part_rows,
    each of which gets the pattern's intervals.
    """
    bucket = lambda at: F.floor(F.unix_date(F.to_date(at)) / BUCKET_DAYS)
    first, last = (F.lit(x).cast("timestamp") for x in captures.agg(F.min("fetched_at"), F.max("fetched_at")).first())
    since, until = F.greatest("valid_from", first), F.least(F.coalesce("valid_to", last), last)
    seen = intervals.filter((F.col("valid_from") <= last) & (F.col("valid_to").isNull() | (F.col("valid_to") > first)))
    spread = written(seen.withColumn("bucket", F.explode(F.sequence(bucket(since), bucket(until)))), "intervals")
    keyed = (
        captures.filter("fetched_at is not null")
        .select("capture", "fetched_at", F.explode(url_keys(F.col("url"))).alias("key"))
        .select("capture", "fetched_at", "key.*", bucket(F.col("fetched_at")).alias("bucket"))
    )
    size = spread.agg(F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length("verdict") + 64), F.lit(0))).first()[0]
    keys = ["kind", "pattern", "bucket"]
    if size <= broadcast_bytes:
        met = keyed.join(F.broadcast(spread), keys)
    else:
        # A part_rows-th of the captures' keys at most.
        hot = written(keyed.groupBy(*keys).count().filter(F.col("count") > part_rows).select(*keys, F.ceil(F.col("count") / part_rows).alias("parts")), "hot-patterns")
        few = F.broadcast if hot.count() <= BROADCAST_HOT else lambda df: df
        parts = F.coalesce("parts", F.lit(1))
        dealt = keyed.join(few(hot), keys, "left").withColumn("part", F.pmod(F.xxhash64("capture"), parts)).drop("parts")
        copied = spread.join(few(hot), keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
        met = dealt.join(copied, [*keys, "part"])
    return met.filter("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)").select("capture", "kind", "pattern", "verdict")


def judge_captures(captures: DataFrame, entries: DataFrame, **options) -> DataFrame:
    """captures(capture_id, url, fetched_at) with n_active, matched ('kind:pattern=verdict', sorted, comma-joined) and kept.

    The most specific active entry decides: a folder before a host before a domain, the longer pattern before the
    shorter; with none, or with an 'allow', the capture is kept. A null or hostless URL and a null fetch time match
    nothing and are kept. Captures are numbered in a written table and judged by number, so repeated rows and rows of
    one or no capture_id each have their own, equal result. Empty tables give empty or unmatched results. Only the
    three columns are read.
    """
    rank = F.expr("struct(case kind when 'path' then 3 when 'host' then 2 else 1 end, length(pattern), pattern)")
    rows = written(captures.select(F.monotonically_increasing_id().alias("capture"), "capture_id", "url", "fetched_at"), "captures")
    found = (
        active_entries(rows, entry_intervals(entries), **options)
        .groupBy("capture")
        .agg(
            F.count("*").alias("n_active"),
            F.array_join(F.sort_array(F.collect_list(F.concat("kind", F.lit(":"), "pattern", F.lit("="), "verdict"))), ",").alias("matched"),
            F.max_by("verdict", rank).alias("verdict"),
        )
    )
    return rows.join(found, "capture", "left").select(
        "capture_id",
        "url",
        "fetched_at",
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.coalesce("matched", F.lit("")).alias("matched"),
        (F.coalesce("verdict", F.lit("allow")) == "allow").alias("kept"),
    )


def derived_captures(pages: DataFrame) -> DataFrame:
    """Captures of a table of pages without fetch times: the times follow from page_id, over one year."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 1000003, F.lit(365 * 86400)))
    return pages.select(F.col("page_id").alias("capture_id"), "url", at.alias("fetched_at"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, domains and folders, drawn by a checksum of each pattern.

    A listed pattern is added, taken off and added again on days that its checksum gives; every third re-entry allows.
    """
    keys = pages.select(F.explode(url_keys(F.col("url"))).alias("key")).select("key.*").distinct()
    code = F.conv(F.substring(F.md5(F.concat("kind", F.lit(" "), "pattern")), 1, 7), 16, 10).cast("long")
    keys = keys.withColumn("code", code).filter("code % 4 = 0")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + F.expr(n) * 86400)
    rows = F.array(
        F.struct(F.lit(True).alias("listed"), F.lit("block").alias("verdict"), day("code % 97").alias("at")),
        F.struct(F.lit(False).alias("listed"), F.lit("block").alias("verdict"), day("100 + code % 89").alias("at")),
        F.struct(
            F.lit(True).alias("listed"),
            F.when(F.col("code") % 3 == 0, F.lit("allow")).otherwise(F.lit("block")).alias("verdict"),
            day("200 + code % 101").alias("at"),
        ),
    )
    return keys.select("kind", "pattern", F.explode(rows).alias("x")).select("kind", "pattern", "x.*")
