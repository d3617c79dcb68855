"""The training-data pipeline: clean, deduplicate, decontaminate, mix and shard the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm import op2_simhash, op3_decontamination, op5_mixing, op8_sharding, op9_quality
from pulseframe.llm.common import materialize, read

SHARDS = 40


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for bad go."""
    return op9_quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return op2_simhash.keep_first(docs)


def benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return op3_decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's target takes it."""
    return op5_mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a place in it."""
    return op8_sharding.shard(docs, op8_sharding.topology(SHARDS)).drop("grown_shard")


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_texts),
    ("source_mixing", source_mix),
    ("sharding", shards),
]

#: The classifier, the fingerprints and the drawn mix have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
