"""Matching navigations with their classifications, and loss checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from urlvane.operators.ordered import top_n_per_group


def first_match_per_id(records: DataFrame, key: str, position: str, last: bool = False) -> DataFrame:
    """One record per id, the first (or last) in file order; combined map-side."""
    others = [c for c in records.columns if c != key]
    pick = F.max_by if last else F.min_by
    best = records.groupBy(key).agg(pick(F.struct(*others), position).alias("_row"))
    return best.select(key, "_row.*")


def correlate_events(navigations: DataFrame, classifications: DataFrame, position: str = "pos",
                     last: bool = False) -> DataFrame:
    """Left join on event id = source_event_id, one match kept."""
    one = first_match_per_id(classifications, "source_event_id", position, last)
    return navigations.join(
        one.withColumnRenamed("source_event_id", "event_id"), "event_id", "left"
    )


def unclassified_events(navigations: DataFrame, classifications: DataFrame) -> DataFrame:
    seen = classifications.select(F.col("source_event_id").alias("event_id"))
    return navigations.join(seen, "event_id", "left_anti")


def archived_not_alerted(navigations: DataFrame, archive: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events without an alert: `rule_failed` when archived, `transport_failed` otherwise."""
    missing = navigations.join(alerts.select("event_id"), "event_id", "left_anti")
    ids = archive.groupBy("event_id").agg(F.lit(True).alias("_archived"))
    return missing.join(ids, "event_id", "left").withColumn(
        "finding", F.when(F.col("_archived"), "rule_failed").otherwise("transport_failed")
    ).drop("_archived")


def retain_latest_n(pending: DataFrame, source: str, time: str, seq: str, n: int = 500) -> DataFrame:
    """Newest n pending events per source."""
    return top_n_per_group(pending, [source], [time, seq], n, descending=True)


def dropped_counts(pending: DataFrame, source: str, n: int = 500) -> DataFrame:
    return pending.groupBy(source).agg(F.count("*").alias("pending")).select(
        source, "pending", F.greatest(F.col("pending") - n, F.lit(0)).alias("dropped")
    )


def tail_n(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    return df.orderBy(*[F.col(o).desc() for o in order]).limit(n)


def provider_exclusive(classifications: DataFrame, expected: str) -> DataFrame:
    """Sources of confirmed verdicts against the one provider that may issue them."""
    return classifications.filter(F.col("status") == "malicious").groupBy("source").agg(
        F.count("*").alias("verdicts")
    ).withColumn("exclusive", F.col("source") == expected)
