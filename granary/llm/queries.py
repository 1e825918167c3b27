"""The queries of this subpackage, with production parameters, over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import cap_filters, decontaminate, jaccard_join, line_dedup, packing, passages, quality, secret_scan, suffix_dedup, token_counts
from granary.llm.oracles import SQL

VOCABULARY = "byte_bpe_50k.json"
#: Sequences of up to 256 documents; what is left of these and of the attention cost chooses a sequence along with what is left of its tokens.
PACKING = {"max_docs": 256, "weights": (1.0, 0.25, 0.25)}


def vocabulary_path() -> str:
    """Where the installed public vocabulary lies; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, as many as are expected to be target text."""
    return quality.resampled_ids(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_read(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary_path(), **PACKING)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), text=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(_read(spark, sf_dir, "documents")).drop("text_key")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), vocabulary_path())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_importance_resampling,
        op2_secret_scan,
        op3_embedding_near_dedup,
        op4_best_fit_packing,
        op5_ngram_jaccard_join,
        op6_suffix_dedup,
        op7_line_dedup,
        op8_token_counts,
        op9_decontamination,
        op10_near_passages,
    )
}

#: Where an operator adds a model, hashing or packing, SQL can't give its rows; tests hold those against brute force.
ORACLE_SQL: dict[str, str] = SQL
