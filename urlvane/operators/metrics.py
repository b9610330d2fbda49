"""Counters, evaluation, model quality and pipeline health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from urlvane.functions import times


def outcome_counters(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    return df.groupBy(outcome).agg(F.count("*").alias("events"))


def evaluation_summary(results: DataFrame) -> DataFrame:
    """Counts by status; `review` is neither suspicious nor counted as evaluated."""
    n = lambda status: F.count_if(F.col("status") == status)
    return results.agg(
        n("suspicious").alias("suspicious"), n("unlikely").alias("unlikely"), n("error").alias("errors"),
        (n("suspicious") + n("unlikely")).alias("evaluated"),
    ).withColumn(
        "suspicious_fraction",
        F.round(F.coalesce(F.try_divide(F.col("suspicious").cast("double"), F.col("evaluated")), F.lit(0.0)), 6),
    )


def quality_gate(summary: DataFrame, fail_under: float | None = None) -> DataFrame:
    low = F.lit(False)
    if fail_under is not None:
        fraction = F.coalesce(F.try_divide(F.col("suspicious").cast("double"), F.col("evaluated")), F.lit(0.0))
        low = fraction < F.lit(fail_under)
    return summary.withColumn("passed", ~(low | (F.col("errors") > 0)))


def confusion(scored: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    predicted = (F.col(score) >= threshold).cast("int")
    return scored.groupBy(F.col(label).cast("int").alias("label"), predicted.alias("predicted")).agg(
        F.count("*").alias("rows")
    )


def classification_report(scored: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted means."""
    table = confusion(scored, threshold, score, label)
    n = lambda actual, predicted: F.coalesce(
        F.sum(F.when((F.col("label") == actual) & (F.col("predicted") == predicted), F.col("rows"))), F.lit(0)
    ).cast("double")
    cells = table.agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    side = {"0": (tn, fn, fp), "1": (tp, fp, fn)}
    values: dict[str, dict[str, Column]] = {}
    for name, (hit, wrong, missed) in side.items():
        values[name] = {"precision": ratio(hit, hit + wrong), "recall": ratio(hit, hit + missed),
                        "f1": ratio(2 * hit, 2 * hit + wrong + missed), "support": hit + missed}
    total = tn + fp + fn + tp
    measures = ("precision", "recall", "f1")
    rows = [(name, *[v[m] for m in measures], v["support"]) for name, v in values.items()]
    rows.append(("macro avg", *[(values["0"][m] + values["1"][m]) / 2 for m in measures], total))
    rows.append(("weighted avg", *[
        ratio(values["0"][m] * values["0"]["support"] + values["1"][m] * values["1"]["support"], total) for m in measures
    ], total))
    accuracy = ratio(tn + tp, total)
    rows.append(("accuracy", accuracy, accuracy, accuracy, total))
    structs = [
        F.struct(F.lit(name).alias("class"), F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"),
                 F.round(f, 9).alias("f1"), s.cast("long").alias("support"))
        for name, p, r, f, s in rows
    ]
    return cells.select(F.inline(F.array(*structs)))


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label", buckets: int = 4096) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Equal scores are combined map-side. Ranking runs inside score buckets; only bucket
    totals are accumulated in one place.
    """
    positive = (F.col(label) == 1).cast("long")
    points = scored.groupBy(F.col(score).alias("s")).agg(
        F.sum(positive).alias("p"), F.sum(F.lit(1) - positive).alias("n")
    ).withColumn("b", F.floor(F.col("s") * buckets))
    totals = points.groupBy("b").agg(F.sum("n").alias("bn"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("b", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("carry"))
    inside = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = points.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, "b")
    won = F.col("p") * (F.col("carry") + F.col("below") + F.col("n") / 2.0)
    return ranked.agg(
        F.sum(won).alias("won"), F.sum("p").alias("positives"), F.sum("n").alias("negatives")
    ).select(
        "positives", "negatives",
        F.round(F.try_divide("won", (F.col("positives") * F.col("negatives")).cast("double")), 9).alias("roc_auc"),
    )


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free fingerprint of a table, one row.

    Each row is hashed by SHA-256 over its fields (`-` for null, else length, colon, text); four lanes of 60 bits of the row
    hashes are added up exactly, and the sums are hashed. Unlike xor, a row added twice changes the sums.
    Sums are combined map-side, so each task sends one row. An empty table has sums of zero.
    """
    text = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
            for c in df.columns]
    digest = df.select(F.sha2(F.concat(*text), 256).alias("d"))
    lane = lambda i: F.conv(F.substring("d", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    sums = digest.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(lane(i)), F.lit(0)).cast("decimal(38,0)").alias(f"l{i}") for i in range(4)])
    joined = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"l{i}").cast("string") for i in range(4)])
    return sums.select("rows", F.sha2(joined, 256).alias("fingerprint"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and length of each file's bytes below a path; a file is read by one task and must fit a row (2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def log_health(tail: DataFrame, url: str = "url", event_type: str = "event_type", expected: str = "browser_navigation") -> DataFrame:
    good = F.coalesce((F.col(event_type) == expected) & (F.col(url) != ""), F.lit(False))
    return tail.agg(
        F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid")
    ).withColumn("healthy", (F.col("valid") > 0) & (F.col("invalid") == 0))


def pipeline_metrics(classified: DataFrame) -> DataFrame:
    """Lookups, hits, errors, fallbacks and latency per provider.

    Unique URLs are counted exactly, by distinct pairs first, then per provider.
    """
    unique = classified.select("provider", "url").distinct().groupBy("provider").agg(F.count("*").alias("unique_urls"))
    plain = classified.groupBy("provider").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("source") == "ml").alias("ml_fallbacks"),
        F.count_if(F.coalesce(F.col("degraded"), F.lit(False))).alias("degraded"),
        F.avg("latency_ms").alias("_latency"),
    )
    rate = lambda a: F.round(F.try_divide(F.col(a).cast("double"), F.col("events")), 9)
    return plain.join(unique, "provider").select(
        "provider", "events", "unique_urls", "cache_hits", "errors", "ml_fallbacks", "degraded",
        rate("cache_hits").alias("hit_ratio"), rate("errors").alias("error_rate"),
        F.round("_latency", 6).alias("avg_latency_ms"),
    )


def threat_types_seen(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(F.explode("threat_types").alias("threat_type")).groupBy("threat_type").agg(
        F.count("*").alias("matches")
    )


def repeat_windows(events: DataFrame, ts: str = "ts", url: str = "url", minutes: int = 5) -> DataFrame:
    """Visits per URL and tumbling window."""
    return events.groupBy(F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes").alias("w"), url).agg(
        F.count("*").alias("visits")
    ).select(F.unix_seconds("w.start").alias("window_start_s"), url, "visits")


def lookup_projection(events: DataFrame, miss_fraction: float, retry_fraction: float = 0.0,
                      days_per_month: int = 30) -> DataFrame:
    """Per day: events, unique URLs, endpoints, and the monthly calls they lead to."""
    day = F.to_date(F.col("ts").cast("timestamp"))
    keyed = events.select(day.alias("day"), "url", "agent_id")
    pairs = keyed.groupBy("day", "url").agg(F.count("*").alias("n"))
    per_day = pairs.groupBy("day").agg(F.sum("n").alias("events"), F.count("*").alias("unique_urls"))
    agents = keyed.select("day", "agent_id").distinct().groupBy("day").agg(F.count("*").alias("endpoints"))
    calls = F.col("unique_urls") * F.lit(miss_fraction) * F.lit(1.0 + retry_fraction)
    return per_day.join(agents, "day").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "events", "unique_urls", "endpoints",
        F.round(F.col("unique_urls") / F.col("events"), 9).alias("unique_fraction"),
        F.round(calls * days_per_month, 6).alias("monthly_calls"),
    )
