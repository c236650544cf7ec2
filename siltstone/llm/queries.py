"""Registered queries of this subpackage: callables and, where SQL can state them, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import byte_bpe, byte_cnn, decontaminate, katz, line_dedup, minhash, quality_rules, secret_ledger, shared, suffix_dedup, toxicity

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"), short=True)


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4, similarity=80)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the corpus go through one ledger: first the documents with ids divisible by 20, then all.

    What the first one scanned is not scanned again; the result is read from the ledger.
    """
    docs, ledger = _table(spark, sf_dir, "documents"), shared.new_path(spark)
    secret_ledger.update_ledger(docs.where("doc_id % 20 = 0"), ledger)
    return secret_ledger.secret_scan(docs, ledger)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_decontamination": op2_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_line_dedup": op4_line_dedup,
        "op5_katz_backoff": op5_katz_backoff,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL,
    }
