"""The registered queries opN_<name>: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textledger.llm import (
    hard_negatives,
    jaccard_join,
    language_id,
    language_model,
    lexical_search,
    mixing,
    quality_classifier,
    quality_rules,
    quotation_links,
    sentencepiece_lattice,
    token_counts,
    token_files,
    topk_search,
)
from textledger.llm.common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_ids(_table(spark, sf_dir, "labels"))
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"), trusted)


def op6_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = quotation_links.quoting_messages(_table(spark, sf_dir, "conversations"))
    return quotation_links.reply_ordered(messages)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", topk_search.whole_numbers(F.col("embedding")).alias("vector"))
    return topk_search.top_k(vectors, F.col("vec_id") % 20 == 0)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_lattice.encode_digest(_table(spark, sf_dir, "documents"), path)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted_languages(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    query.__name__: query
    for query in (
        op1_token_files,
        op2_language_model,
        op3_source_mix,
        op4_jaccard_join,
        op5_quality_rules,
        op6_quotation_links,
        op7_token_counts,
        op8_topk_search,
        op9_sentencepiece,
        op10_quality_classifier,
        op11_language_id,
        op12_hard_negatives,
        op13_lexical_search,
        pipeline,
    )
}
