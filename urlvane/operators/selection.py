"""URL-list selection, samples and labelled sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from urlvane import fixed_values as fv
from urlvane.functions import urls
from urlvane.functions.columns import settle
from urlvane.operators.features import url_features_legacy, url_features_modern
from urlvane.operators.ordered import first_rows, top_n_per_group


def verification_state(value: Column) -> Column:
    """False, True or unknown (NULL)."""
    word = F.lower(urls.stripped(value.cast("string")))
    return F.when(word.isin(fv.UNVERIFIED_WORDS), False).when(word.isin(fv.VERIFIED_WORDS), True)


def filter_unverified(df: DataFrame, column: str = "verified", include_verified: bool = False) -> DataFrame:
    """Keep rows that say they are unverified; unknown counts as not unverified."""
    if include_verified or column not in df.columns:
        return df
    return df.filter(~F.coalesce(verification_state(F.col(column)), F.lit(True)))


def valid_sample_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add sample_url (trimmed), sample_host and sample_ok."""
    df = df.withColumn("sample_url", urls.stripped(F.col(url)))
    df = urls.with_url_parts(df, "sample_url", "_s_")
    ok = (F.length("sample_url") <= fv.MAX_URL_LENGTH) & urls.is_web("_s_") & ~urls.has_credentials("_s_")
    df = df.withColumns({"sample_ok": F.coalesce(ok, F.lit(False)), "sample_host": F.col("_s_host")})
    return urls.drop_url_parts(df, "_s_")


def select_samples(records: DataFrame, limit: int | None = 1000, position: str = "pos", url: str = "url",
                   verified: str = "verified", include_verified: bool = False) -> DataFrame:
    """Add `reason` (verified_skipped, invalid, duplicate or selected) up to the limit; None takes the whole list.

    Rows after the one that reached the limit are left out, as if never read.
    """
    df = valid_sample_url(records, url)
    skipped = F.lit(False)
    if verified in records.columns and not include_verified:
        skipped = F.coalesce(verification_state(F.col(verified)), F.lit(True))
    df = settle(df, {"_pre": F.when(skipped, "verified_skipped").when(~F.col("sample_ok"), "invalid")})
    firsts = first_rows(df.filter(F.col("_pre").isNull()).select(position, "sample_url"), ["sample_url"], position, "_first")
    firsts = firsts.filter("_first").select(position, "_first")
    df = df.join(firsts, position, "left").withColumn(
        "reason",
        F.coalesce("_pre", F.when(F.coalesce("_first", F.lit(False)), "selected").otherwise("duplicate")),
    ).drop("_pre", "_first")
    if limit is None:
        return df
    cut = firsts.orderBy(position).limit(limit).agg(
        F.when(F.count("*") >= limit, F.max(position)).alias("cut")
    )
    stop = cut.scalar()
    return df.filter(stop.isNull() | (F.col(position) <= stop))


def selection_counts(selected: DataFrame) -> DataFrame:
    count = lambda reason, name: F.count_if(F.col("reason") == reason).alias(name)
    return selected.agg(
        F.count("*").alias("rows"), count("invalid", "invalid"), count("verified_skipped", "verified_skipped"),
        count("duplicate", "duplicates"), count("selected", "selected"),
    )


def sample_n(df: DataFrame, n: int, key: str, group: list[str] | None = None, seed: int = 12) -> DataFrame:
    """A repeatable sample of n rows per group, ordered by a seeded hash of a unique key."""
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    hashed = df.withColumn("_hash", order).withColumn("_all", F.lit(0))
    return top_n_per_group(hashed, group or ["_all"], ["_hash", key], n).drop("_hash", "_all")


def clean_labels(df: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    """Trimmed URL and 0/1 label of rows whose features can be computed."""
    df = df.select(urls.stripped(F.col(url)).alias("url"), F.col(label).cast("string").try_cast("int").alias("label"))
    return df.filter(F.col("label").isin(0, 1) & urls.is_web_url("url"))


def dedupe_labels(df: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    """One row per URL with its label and `conflict` when both labels were seen."""
    return clean_labels(df, url, label).groupBy("url").agg(
        F.min("label").alias("label"), (F.min("label") != F.max("label")).alias("conflict")
    )


def class_counts(labeled: DataFrame) -> DataFrame:
    """Rows per label, with the training guard (100 rows in all, 10 per class)."""
    return labeled.groupBy("label").agg(F.count("*").alias("rows"))


def training_guard(labeled: DataFrame) -> DataFrame:
    return labeled.agg(
        F.count("*").alias("rows"), F.count_if(F.col("label") == 0).alias("rows_0"),
        F.count_if(F.col("label") == 1).alias("rows_1"), F.countDistinct("label").alias("classes"),
    ).withColumn(
        "trainable",
        (F.col("rows") >= 100)
        & ((F.col("rows_0") >= 10) | (F.col("rows_0") == 0)) & ((F.col("rows_1") >= 10) | (F.col("rows_1") == 0)),
    )


def union_labeled(legitimate: DataFrame, phishing: DataFrame) -> DataFrame:
    return legitimate.withColumn("label", F.lit(0)).unionByName(phishing.withColumn("label", F.lit(1)))


def feature_dataset(labeled: DataFrame, n: int, registration: DataFrame | None = None,
                    pages: DataFrame | None = None, now: str | None = None, seed: int = 12) -> DataFrame:
    """Sample n URLs per label, extract the legacy features, name them as the feature files do."""
    sampled = sample_n(labeled, n, "url", ["label"], seed)
    rows = url_features_legacy(sampled, "url", registration, pages, now).filter(F.col("feature_error").isNull())
    sources = ["site_domain", *fv.LEGACY_FEATURES, "label"]
    return rows.select(*[F.col(s).alias(name) for s, name in zip(sources, fv.FEATURE_FILE_COLUMNS)])


def modern_dataset(labeled: DataFrame) -> DataFrame:
    """Conflict-free labelled URLs with the modern features."""
    rows = dedupe_labels(labeled).filter(~F.col("conflict")).drop("conflict")
    return url_features_modern(rows).drop("feature_error")
