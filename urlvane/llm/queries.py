"""Queries of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from urlvane.llm import (
    byte_bpe, decontaminate, hmm, language_id, line_templates, manifest, near_duplicates, nearest, packing, spelling, suffix_dedup,
    token_counts, toxicity,
)
from urlvane.llm.shared import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark, sf):
    return language_id.identify(table(spark, sf, "documents"))


@query
def op2_suffix_dedup(spark, sf):
    kept = suffix_dedup.kept_bytes(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_token_counts(spark, sf):
    return token_counts.section_counts(table(spark, sf, "documents"))


@query
def op4_decontamination(spark, sf):
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op5_byte_bpe(spark, sf):
    return byte_bpe.round_trip(table(spark, sf, "documents"))


@query
def op6_toxicity(spark, sf):
    return toxicity.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op7_near_duplicates(spark, sf):
    return near_duplicates.near_duplicates(table(spark, sf, "documents"), words=4)


@query
def op8_line_templates(spark, sf):
    found = line_templates.drop_recurring(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


@query
def op9_language_model(spark, sf):
    held = remainder("doc_id", 7) == 2
    found = hmm.score(table(spark, sf, "documents"), held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_nearest(spark, sf):
    return nearest.search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op11_packing(spark, sf):
    return packing.piece_digests(packing.pack(table(spark, sf, "documents")))


@query
def op12_spelling(spark, sf):
    return spelling.variant_groups(spelling.word_counts(table(spark, sf, "documents")))


@query
def op13_manifest(spark, sf):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(remainder("doc_id", 5) == 0, manifest.leaf(*fields[:-1], manifest.lower_ascii("text")))
    return manifest.checked(manifest.manifest(table(spark, sf, "documents"), fields, altered=tampered))
