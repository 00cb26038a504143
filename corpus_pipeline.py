"""A training corpus from documents: filtered, de-duplicated, mixed and packed, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import mixing, near_dedup, packing, quality_classifier, quality_rules
from changelens.llm.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels by which rules and classifier are fitted: doc_id, quality, toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the certified cutoffs keep. Null and empty texts go; repeated rows are judged alike."""
    judged = quality_rules.apply_quality_rules(docs, labels(spark, sf_dir), whole=True)
    return judged.filter("kept").select("document.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose posterior of being bad is at most a half. A null source or language is a site of its own."""
    judged = quality_classifier.classify(docs, labels(spark, sf_dir), whole=True)
    return judged.filter("kept").select("document.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies. Rows, not ids, are judged: null and repeated ids are documents of their own."""
    return near_dedup.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix draws them, repeated or cut, shard by shard; n_chars is counted anew. Wordless ones go."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; a null text is an end mark alone."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [("rules", rules), ("classifier", classifier), ("dedup", dedup), ("mix", mix), ("pack", pack)]

#: Signatures, random mixing draws and bin packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents.

    Each stage but the last is written and read again, so a lost executor costs its own tasks. Columns beyond those that
    the stages name are carried along, whatever their names. Nulls, empty texts and repeated rows are as each stage
    says; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
