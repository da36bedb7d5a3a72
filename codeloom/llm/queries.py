"""The registered queries of this subpackage and, where SQL can say it, their oracles.

Each ``opN_<name>`` takes (spark, sf_dir), applies its operator with production
parameters to the whole table, and derives the columns that are asked for.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, class_lm, images, langid, lexical, ngram_join, packing, quality, secrets, sharding, substring_dedup, token_counts, whitening
from .frames import shared_folder, small_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(documents(spark, sf_dir), shared_folder(spark, "shards"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return images.copies(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORDS).drop("ids")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(documents(spark, sf_dir))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secrets": op5_secrets,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language_id": op7_language_id,
    "op8_image_copies": op8_image_copies,
    "op9_packing": op9_packing,
    "op10_ngram_join": op10_ngram_join,
    "op11_whitening": op11_whitening,
    "op12_class_lm": op12_class_lm,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {"op1_sharding": sharding.REPORT_SQL, "op2_quality_rules": quality.REPORT_SQL, "op4_substring_dedup": substring_dedup.DIGEST_SQL, "op10_ngram_join": ngram_join.JOIN_SQL, "op13_ranked_search": lexical.SEARCH_SQL}
