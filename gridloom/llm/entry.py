"""The registered queries of this subpackage, each one operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, forest, media, perspectives, quality, sharding, suffixes, surrogates, tiling, toxicity
from gridloom.llm.common import table


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.perspectives(table(spark, sf_dir, "conversations"))


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxic_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op6_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.surrogates(docs, count_col="n_entities")


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.feistel_shards(table(spark, sf_dir, "documents"), shards=40)


QUERIES = {
    f.__name__: f
    for f in (op1_perspectives, op2_quality_discriminant, op3_toxic_instances, op4_string_tiling, op5_suffix_trees, op6_media_jpeg, op7_byte_bpe, op8_surrogates, op9_lsh_forest, op10_feistel_shards)
}
ORACLES = {"op1_perspectives": perspectives.ORACLE_SQL}
