"""The subpackage's registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import alignment, byte_bpe, license_scan, merkle, mixing, near_dedup, neighbours, oracles, packing, quality_classifier, quality_rules, sharding, token_shards, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.lpt_shards(table(spark, sf_dir, "documents"), 40)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.training_order(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filters.judge_captures(url_filters.derived_captures(pages), url_filters.derived_entries(pages))
    return judged.withColumn("fetched_s", F.unix_timestamp("fetched_at")).drop("fetched_at")


def op7_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"))


def op10_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digests(table(spark, sf_dir, "documents"))


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_site_classifier, op2_lpt_sharding, op3_license_scan, op4_quality_rules, op5_training_order, op6_url_filter, op7_super_minhash, op8_source_mixture, op9_multiprobe_search, op10_bin_slack_packing, op11_merkle_manifest, op12_lockstep_alignment, op13_byte_bpe)
    return {f.__name__: f for f in found}


oracle_sql = oracles.oracle_sql
