"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowsift.llm.bpe import digest_documents
from flowsift.llm.lexical import rank_documents
from flowsift.llm.licenses import licence_notices
from flowsift.llm.merkle import seal_documents
from flowsift.llm.oracle import ORACLE  # noqa: F401  part of the registration
from flowsift.llm.packing import pack_documents
from flowsift.llm.pii import pii_report
from flowsift.llm.pitman_yor import score_documents
from flowsift.llm.prefix_free import without_repeats
from flowsift.llm.quality import quality_report
from flowsift.llm.secret_scan import secret_report
from flowsift.llm.sharding import shard_documents
from flowsift.llm.simhash import simhash_classes
from flowsift.llm.topk import search_embeddings

SHARDS = 24
SEQUENCE_TOKENS = 2048


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), SEQUENCE_TOKENS, vocabulary("byte_bpe_50k.json"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_notices(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(documents(spark, sf_dir))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), SHARDS)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(documents(spark, sf_dir))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seal_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_license_scans": op2_license_scans,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_pii": op5_pii,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_sharding": op7_sharding,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_secret_scans": op10_secret_scans,
    "op11_ranked_search": op11_ranked_search,
    "op12_repeated_passages": op12_repeated_passages,
    "op13_merkle_manifest": op13_merkle_manifest,
}
