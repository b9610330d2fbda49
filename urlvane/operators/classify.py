"""The decision table: reputation first, score as fallback, every failure visible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from urlvane import fixed_values as fv
from urlvane.functions.columns import per_distinct, settle
from urlvane.settings import Settings


def ml_band(score: Column, threshold: Column, review: Column) -> Column:
    """suspicious / review / unlikely, or NULL without a score or where review is not below threshold."""
    usable = (review >= 0) & (review < threshold) & score.isNotNull()
    return F.when(
        usable,
        F.when(score >= threshold, "suspicious").when(score >= review, "review").otherwise("unlikely"),
    )


def score_unconfirmed(df: DataFrame, scorer: Callable[[DataFrame, str], DataFrame], confirmed: Column,
                      url: str = "url") -> DataFrame:
    """Hand the scorer a NULL URL for confirmed rows, so they cost nothing and get no score.

    One pass over the rows: no split and no union. The form for streams, and for scorers
    too costly to run on confirmed URLs; see `score_distinct` for tables.
    """
    given = df.withColumn("_score_url", F.when(~confirmed, F.col(url)))
    return scorer(given, "_score_url").drop("_score_url")


def score_distinct(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], url: str = "url") -> DataFrame:
    """Score each distinct URL once and join the scores back; navigations repeat URLs a lot."""
    return per_distinct(df, url, scorer)


def classify_navigation(df: DataFrame, settings: Settings, provider: str | None = None) -> DataFrame:
    """Add the classification columns.

    Expected: rep_status, rep_malicious; `rep_failure` (NULL, error, quota_guard or
    circuit_open) with `rep_error`; and, when scoring is on, score, threshold,
    model_version, model_kind and calibrated (ignored for confirmed rows).
    """
    provider = F.lit(provider or settings.provider)
    c = F.col
    failed = c("rep_failure").isNotNull()
    confirmed = ~failed & F.coalesce(c("rep_malicious"), F.lit(False))
    plain = ~failed & ~confirmed
    none = F.lit(None).cast("string")

    if settings.ml_enabled:
        review = F.lit(settings.review_threshold)
        df = settle(df, {"_band": F.when(~confirmed, ml_band(c("score"), c("threshold"), review))})
        bad = ~confirmed & c("_band").isNull()
        unscored = c("score").isNull()
        bad_text = F.when(unscored, "URL must be HTTP or HTTPS with a hostname").otherwise(
            "ml.review_threshold must be lower than the effective ML threshold"
        )
        bad_type = F.when(unscored, "ValueError").otherwise("ClassificationError")
    else:
        review = F.lit(None).cast("double")
        df = df.withColumns({
            "_band": none, "score": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double"),
            "model_version": none, "model_kind": none, "calibrated": F.lit(None).cast("boolean"),
        })
        bad = failed
        bad_text, bad_type = c("rep_error"), F.lit("ClassificationError")
    band = c("_band")
    scored = ~confirmed & band.isNotNull()
    weak = failed & (band == "unlikely")
    status = (
        F.when(bad, "error").when(confirmed, "malicious").when(weak, "error")
        .when(scored, band).otherwise(c("rep_status"))
    )
    source = (
        F.when(bad | weak, "classifier").when(confirmed, provider)
        .when(scored, "ml").otherwise(provider)
    )
    keep = lambda name: F.when(scored & ~bad, c(name))
    return settle(df, {
        "status": status,
        "malicious": F.coalesce(F.when(bad, False).when(confirmed, True).otherwise(band == "suspicious"), F.lit(False)),
        "source": source,
        "reputation_provider": F.when(~bad, provider),
        "degraded": F.when(~bad & failed, True),
        "reputation_status": F.when(~bad & failed, c("rep_failure")),
        "reputation_error": F.when(~bad & failed & ~weak, c("rep_error")),
        "ml_status": F.when(~bad & weak, "unlikely"),
        "error": F.when(bad, bad_text).when(weak, c("rep_error")),
        "error_type": F.when(bad, bad_type),
        "score": keep("score"), "threshold": keep("threshold"),
        "review_threshold": F.when(scored & ~bad, review),
        "model_version": keep("model_version"), "model_kind": keep("model_kind"), "calibrated": keep("calibrated"),
    }).drop("_band")


def error_results(df: DataFrame, error: str = "error") -> DataFrame:
    """Rows that failed before classification, as visible error classifications."""
    blank = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    return df.select(
        F.lit("error").alias("status"), F.lit(False).alias("malicious"), F.lit("classifier").alias("source"),
        F.lit("ClassificationError").alias("error_type"), F.col(error).alias("error"),
        *[blank(n) for n in ("url", "url_host", "source_event_id", "source_alert_id", "source_rule_id")],
    )


def classification_events(df: DataFrame, fields: list[str]) -> DataFrame:
    """The nested event: integration, schema_version and one classification struct."""
    return df.select(
        F.lit(fv.INTEGRATION).alias("integration"), F.lit(fv.SCHEMA_VERSION).alias("schema_version"),
        F.struct(*fields).alias("classification"),
    )
