"""The registered queries of this subpackage: each applies its operator to the whole table and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import audit, blocks, bpe, extraction, jaccard, lengths, maxent, periods, pigeonhole, quality, sharding, suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(_table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.query(_table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that stands in it."""
    return pigeonhole.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for every encoded length as a context limit."""
    return lengths.query(_table(spark, sf_dir, "documents"))


def op11_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.query(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.query(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_shards": op1_hilbert_shards,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_toxicity": op4_toxicity,
        "op5_quality": op5_quality,
        "op6_main_text": op6_main_text,
        "op7_shingle_join": op7_shingle_join,
        "op8_language_model": op8_language_model,
        "op9_decontamination": op9_decontamination,
        "op10_token_counts": op10_token_counts,
        "op11_block_dedup": op11_block_dedup,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    """Only the audit can be said in SQL at the size of whole tables; tests/llm holds the others against brute force."""
    return {"op13_filter_audit": audit.SQL}
