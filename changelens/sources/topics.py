"""Event topics: reading, checked writing, keys and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

RAW = "key string, value string, topic string, `offset` bigint, ts timestamp"
EVENTS = {
    "webhook.received": "type string, webhookEventId string, deliveryId string, eventType string, action string",
    "review.requested": "type string, installationId bigint, repoFullName string, prNumber int, headSha string, trigger string, requestedBy string",
    "repo.index.requested": "type string, repositoryId string, installationId bigint, ref string, reason string",
}


def read_topic(spark: SparkSession, topic: str, *, servers: str | None = None, path: str | None = None, start: str = "latest") -> DataFrame:
    """A topic as a stream of RAW rows: from a broker, or from JSON files below path where there is none.

    On the first start a broker is read from its latest message; later, the query's checkpoint goes on.
    """
    if path:
        return spark.readStream.schema(RAW).json(path).filter(F.col("topic") == topic)
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "offset", F.col("timestamp").alias("ts"))


def topic_key(kind: str, *columns: Column) -> Column:
    """The message key: 'pr' of (repository, number), 'repo' of an id, 'delivery' of a delivery id."""
    if kind == "pr":
        return F.concat(F.lower(columns[0]), F.lit("#"), columns[1].cast("string"))
    return F.concat(F.lit("repo:"), columns[0].cast("string")) if kind == "repo" else columns[0].cast("string")


def to_messages(df: DataFrame, topic: str, key: Column, columns: list[str]) -> DataFrame:
    return df.select(key.alias("key"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"), F.lit(topic).alias("topic"))


def write_topic(messages: DataFrame, *, checkpoint: str, servers: str | None = None, path: str | None = None) -> DataStreamWriter:
    """Messages to their topic: to a broker, or to JSON files below path."""
    writer = messages.writeStream.option("checkpointLocation", checkpoint)
    return writer.format("json").option("path", path) if path else writer.format("kafka").option("kafka.bootstrap.servers", servers)


def dead_letter(failed: DataFrame) -> DataFrame:
    """Rows(key, value, topic, reason) as messages of the topic's dead-letter topic, with where and why as headers."""
    header = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))
    return failed.select(
        "key",
        "value",
        F.concat("topic", F.lit(".dlq")).alias("topic"),
        F.array(header("x-error", F.substring("reason", 1, 1000)), header("x-original-topic", F.col("topic"))).alias("headers"),
    )
