"""From raw documents to training ids: rules, classifier, near copies, source mix, encoding; each stage works on the last."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textledger.llm import jaccard_join, mixing, quality_classifier, quality_rules, sentencepiece_lattice
from textledger.llm.common import small_batches
from textledger.sources.shared import stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(_labels(spark, sf_dir)))


def good_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_classifier.keep_good(docs, _labels(spark, sf_dir))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip of each row of the mix."""
    small_batches(spark, 512)  # what a slice has; the JVM's buffers come on top of a full heap
    return sentencepiece_lattice.encode_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", good_by_rules),
    ("quality classifier", good_by_classifier),
    ("near copies", without_near_copies),
    ("source mix", mixed_sources),
    ("encoding", encoded),
]

#: Neither hashed scores nor merges of pieces can be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
