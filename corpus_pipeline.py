"""A training-data pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import byte_bpe, decontaminate, line_dedup, minhash, shared, toxicity
from siltstone.llm.queries import VOCABULARY


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; the model learns from the labelled source tables.

    Null and empty texts score low and stay; repeated rows and null ids are judged by their texts.
    """
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(model) < 0.5)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, short ones exactly and others within the edit threshold.

    Every row stays, though perhaps without text; null texts and rows without id are left as they are.
    """
    return line_dedup.without_dropped(docs, short=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the least id of each component; texts without words and rows without id stay.

    Rows of one id and different texts are judged one by one.
    """
    return minhash.without_duplicates(docs, k=5, similarity=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window verifies as a benchmark item; null and empty texts stay."""
    return docs.where(decontaminate.clean_column(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the digests of the ids and of the bytes they decode to; a null text has none."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: SQL cannot state the learned and iterative stages; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what passes from one to the next is a written table, and all older tables are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = shared.mark()
    for _, stage in STAGES[:-1]:
        docs, path = shared.table(stage(spark, docs, sf_dir))
        shared.drop_since(spark, place, path)
    return STAGES[-1][1](spark, docs, sf_dir)
