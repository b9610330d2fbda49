"""A training corpus from the documents table, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urlvane.llm import byte_bpe, decontaminate, language_id, line_templates, near_duplicates
from urlvane.llm.shared import written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages."""
    return language_id.keep_identified(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across documents."""
    return line_templates.drop_recurring(docs).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ids decode to their text, with the number and digest of the ids."""
    return byte_bpe.keep_round_trips(docs)


STAGES = [
    ("language_id", identified), ("line_dedup", without_boilerplate), ("near_dedup", one_of_each),
    ("decontamination", decontaminated), ("byte_bpe", encoded),
]

#: Stages learn, hash and encode; SQL can't express them, tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
