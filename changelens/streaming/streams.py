"""Streaming forms of the event operators. Effects go through keyed, repeatable writes of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from changelens.operators.events import parse_events
from changelens.sources.buckets import Buckets, Latest, merge
from changelens.sources.topics import dead_letter

#: Installations and repositories as they follow from events in any order; see Latest. The user's own switch comes as an
#: event that only fills auto_review_enabled, so no other event undoes it.
INSTALLATIONS = Latest(["installation_id"], ["at", "seq"], known=["status", "account_login"], first=["owner_user_id"])
REPOSITORIES = Latest(
    ["github_repo_id"], ["at", "seq"], known=["installation_id", "full_name", "private", "html_url", "language", "description", "active", "auto_review_enabled"]
)


def split_events(raw: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid events, rows for the dead-letter topic) of a raw stream."""
    parsed = parse_events(raw, kind)
    valid = parsed.filter("reason is null").select("key", "offset", "ts", "event.*")
    return valid, dead_letter(parsed.filter("reason is not null"))


def append_new(rows: DataFrame, path: str, key: str, n: int = 64) -> None:
    """Appends those rows whose key the table below path doesn't hold yet.

    The table is dealt to n buckets of the key's hash. Only the keys of the rows' own buckets are read. A batch that runs
    again finds what it wrote before, whatever became of its checkpoint.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).persist()
    try:
        touched = [r["_bucket"] for r in dealt.select("_bucket").distinct().collect()]
        if not touched:
            return
        kind = rows.schema[key].dataType.simpleString()
        try:
            known = spark.read.schema(f"`{key}` {kind}, `_bucket` int").parquet(path).filter(F.col("_bucket").isin(touched))
            dealt = dealt.join(known, ["_bucket", key], "left_anti")
        except AnalysisException as error:  # nothing was ever written
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        dealt.write.mode("append").partitionBy("_bucket").parquet(path)
    finally:
        dealt.unpersist()


def ingest_stream(events: DataFrame, path: str, checkpoint: str, *, wait: str = "1 hour", arrived: Column | None = None, buckets: int = 64) -> DataStreamWriter:
    """events(delivery_id, ...) into a Parquet table in which a delivery id comes once, for ever.

    Repeats that arrive within `wait` of each other are told by stream state, which ends after it; later ones by the
    table itself, of which a batch reads the ids in its own buckets. The watermark runs over the time of arrival,
    not over a time in the event, so no event is too late to be taken. arrived is the clock, by default the batch's.
    """
    clock = F.current_timestamp() if arrived is None else arrived
    once = events.withColumn("_arrived", clock).withWatermark("_arrived", wait).dropDuplicatesWithinWatermark(["delivery_id"]).drop("_arrived")
    save = lambda batch, _: append_new(batch, path, "delivery_id", buckets)
    return once.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def keyed_table(changes: DataFrame, rule: Latest, path: str, n: int = 256) -> Buckets:
    """The table that upsert_stream keeps of such changes."""
    return Buckets(path, rule.schema(changes), rule.keys, n)


def upsert_stream(changes: DataFrame, rule: Latest, table: Buckets, checkpoint: str) -> DataStreamWriter:
    """A table of states that follows a stream of changes by a rule.

    A batch reads and rewrites the buckets of its own keys. States are dated, so a batch that runs again, or all of them
    after a lost checkpoint, leave the table as it was.
    """
    return changes.writeStream.foreachBatch(lambda batch, _: merge(table, rule, batch)).option("checkpointLocation", checkpoint)


def publish_stream(events: DataFrame, send: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Sends each batch and records what was sent: send returns (delivery_id, sent_at) of its successes.

    The record is written after sending, each id once with the first time that was noted. What isn't in it is still
    received, for the sweep.
    """

    def save(batch: DataFrame, _: int) -> None:
        sent = send(batch).groupBy("delivery_id").agg(F.min("sent_at").alias("sent_at"))
        append_new(sent, path, "delivery_id")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def with_retries(rows: DataFrame, retries: str) -> DataFrame:
    """rows together with what retry_or_dead_letter has put below retries: with attempt, and not_before of a second one on."""
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", attempt int, not_before timestamp"
    spark.createDataFrame([], schema).write.mode("ignore").json(f"{retries}/start")
    again = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(retries)
    return rows.withColumns({"attempt": F.lit(1), "not_before": F.lit(None).cast("timestamp")}).unionByName(again)


def retry_or_dead_letter(
    rows: DataFrame, handle: Callable[[DataFrame], DataFrame], failed: Callable[[DataFrame, int], None], checkpoint: str, retries: str, *,
    most: int = 3, pause: float = 1.0, key: str = "row_key",
) -> DataStreamWriter:
    """Hands each batch to handle, which returns (key, error) of the rows that failed; these come back in later batches.

    Nothing waits for them: a failed row goes to the retry topic, the folder retries, with its number of attempts and
    the time before which it isn't due, 1, 2, 4 ... pauses on, and the query reads that topic beside its source. A row
    that isn't due yet goes round once more. After `most` attempts a row goes to failed, with its last error as reason.
    A batch's retries are one folder, which it replaces if it runs again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        columns = [c for c in batch.columns if c not in ("attempt", "not_before")]
        due = F.col("not_before").isNull() | (F.col("not_before") <= F.current_timestamp())
        ready = batch.filter(due).persist()
        early = batch.join(ready.select(key), key, "left_anti")
        errors = None
        try:
            errors = handle(ready.select(*columns)).persist()
            again = ready.join(errors.groupBy(key).agg(F.max("error").alias("error")), key)
            dead = again.filter(F.col("attempt") >= most)
            if not dead.isEmpty():
                reason = F.concat(F.lit(f"failed after {most} attempts: "), F.coalesce("error", F.lit("")))
                failed(dead.withColumn("reason", reason).select(*columns, "reason"), batch_id)
            seconds = F.lit(pause) * F.pow(F.lit(2.0), F.col("attempt") - 1)
            after = F.timestamp_millis((F.unix_millis(F.current_timestamp()) + seconds * 1000).cast("long"))
            later = again.filter(F.col("attempt") < most).withColumn("not_before", after).withColumn("attempt", F.col("attempt") + 1)
            waiting = later.select(*columns, "attempt", "not_before").unionByName(early.select(*columns, "attempt", "not_before"))
            if not waiting.isEmpty():
                waiting.write.mode("overwrite").json(f"{retries}/{batch_id:012d}")
        finally:
            for df in (batch, ready, errors):
                if df is not None:
                    df.unpersist()

    return with_retries(rows, retries).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def ordered_by_key(batch: DataFrame, key: str = "key", order: str = "offset") -> DataFrame:
    """A batch's rows so that a key's rows lie in one partition, in order; other keys run beside them."""
    return batch.repartition(F.col(key)).sortWithinPartitions(key, order)


def sweep_stream(ticks: DataFrame, sweep: Callable[[SparkSession], None], checkpoint: str) -> DataStreamWriter:
    """Runs sweep once a batch of ticks, such as a rate source's: the recovery jobs as a stream."""
    return ticks.writeStream.foreachBatch(lambda batch, _: sweep(batch.sparkSession)).option("checkpointLocation", checkpoint)
