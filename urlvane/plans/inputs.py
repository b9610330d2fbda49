"""Working tables derived from the given ones, by formulas that plain SQL can repeat.

Texts ending in `_SQL` are the same expression in Spark and in the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from urlvane import fixed_values as fv
from urlvane.functions import times

NOW = "2024-02-01T00:00:00Z"
NOW_S = 1706745600

HOST_SQL = "regexp_extract(url, '^https?://([^/?#]*)', 1)"

# A URL text per page that covers the awkward cases: credentials, search terms, secrets,
# ports, address hosts, punycode, other schemes, empty text.
MESSY_URL_SQL = f"""
CASE page_id % 12
  WHEN 0 THEN url
  WHEN 1 THEN replace(url, '://', '://user:pw@')
  WHEN 2 THEN 'https://www.bing.com/search?q=' || CAST(page_id AS STRING) || '+words&FORM=TEST&pq=x&token=1&b=2&a=1&b=1#top'
  WHEN 3 THEN 'HTTP://' || upper({HOST_SQL}) || ':8080/login@x?Token=1&token=2&token=3&a'
  WHEN 4 THEN 'ftp://' || {HOST_SQL} || '/file'
  WHEN 5 THEN 'https://192.0.2.' || CAST(page_id % 256 AS STRING) || '/verify/account//update'
  WHEN 6 THEN 'http://xn--' || CAST(page_id AS STRING) || '-a.' || {HOST_SQL} || '/%D0%B0?a&b=&&c=*~&d=1;2'
  WHEN 7 THEN ''
  WHEN 8 THEN 'https://bit.ly/' || CAST(page_id AS STRING)
  WHEN 9 THEN 'https://www.' || {HOST_SQL} || ':443/www.secure/login?session=abc&next=home'
  WHEN 10 THEN 'not a url ' || CAST(page_id AS STRING)
  ELSE 'https://[2001:db8::' || CAST(page_id % 1000 AS STRING) || ']:99999/p?x=%41'
END
"""

DIRTY_SQL = {
    "schema_version": "CASE WHEN seq % 17 = 1 THEN 2 ELSE 1 END",
    "event_type": "CASE WHEN seq % 17 = 13 THEN 'page_view' ELSE 'browser_navigation' END",
    "event_id": "CASE WHEN seq % 17 = 0 THEN '' ELSE event_id END",
    "timestamp": "CASE WHEN seq % 17 = 10 THEN '2024-01-05 10:00:00' WHEN seq % 17 = 15 THEN replace(stamp, 'Z', '+02:00') ELSE stamp END",
    "browser": "CASE WHEN seq % 17 = 4 THEN 'other' ELSE 'edge' END",
    "url": "CASE WHEN seq % 17 = 3 THEN replace(url, 'http', 'ftp') WHEN seq % 17 = 11 THEN '' WHEN seq % 17 = 14 THEN 'not a url' "
           "WHEN seq % 17 = 16 THEN 'https://u:p@example.test/login?token=' || CAST(seq AS STRING) || '&a=' || CAST(seq % 5 AS STRING) || '#private' ELSE url END",
    "url_host": "CASE WHEN seq % 17 = 2 THEN 'attacker.test' WHEN seq % 17 = 16 THEN 'EXAMPLE.test' WHEN seq % 3 = 0 THEN '' ELSE regexp_extract(url, '^https?://([^/?#]*)', 1) END",
    "tab_id": "CASE WHEN seq % 17 = 5 THEN -1 ELSE tab_id END",
    "document_id": "CASE WHEN seq % 17 = 12 THEN repeat('d', 129) END",
    "navigation_kind": "CASE WHEN seq % 17 = 6 THEN 'reload' ELSE navigation_kind END",
    "transition_type": "CASE WHEN seq % 17 = 7 THEN '' ELSE 'link' END",
    "source": "'edge_extension'",
}

# A transparent linear score standing in for a trained model.
SCORE_SQL = (
    "round(least(1.0, greatest(0.0, 0.01 + 0.12 * hostname_has_dash + 0.02 * path_depth "
    "+ 0.15 * (1.0 - uses_https) + 0.2 * suspicious_token_count + 0.3 * hostname_is_ip "
    "+ 0.1 * query_parameter_count)), 6)"
)
SCORE_THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


def messy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.expr(MESSY_URL_SQL).alias("url"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def nav_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Every event with the page it visits; `seq` is the unique event number."""
    known = pages(spark, sf_dir)
    events = table(spark, sf_dir, "events") if events is None else events
    events = events.select("event_id", "ts", "user_id", "event_type", "value")
    total = table(spark, sf_dir, "pages").agg(F.count("*")).scalar()
    visits = events.withColumn("page_id", F.col("event_id") % total)
    return visits.join(known, "page_id").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        "ts", times.epoch_ms("ts").alias("ts_ms"), times.epoch_s("ts").alias("ts_s"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("stamp"),
        F.col("user_id").alias("tab_id"),
        F.when(F.col("event_type") == "view", "history_state").otherwise("committed").alias("navigation_kind"),
        F.lit(None).cast("string").alias("document_id"),
        (F.col("user_id") % 7).cast("string").alias("agent_id"),
        "page_id", "url", "event_type", "value",
    )


def nav_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw browser details with sub-frames."""
    return nav_events(spark, sf_dir).select(
        "seq", "event_id", "stamp",
        (F.col("seq") % 4).cast("int").alias("frameId"), F.col("tab_id").alias("tabId"),
        F.when(F.col("seq") % 8 == 0, "https://user:pw@example.test/a?token=1&x=2").otherwise(F.col("url")).alias("url"),
        F.when(F.col("seq") % 3 == 0, "doc").when(F.col("seq") % 3 == 1, "").alias("documentId"),
        F.when(F.col("seq") % 5 != 0, "link").alias("transitionType"),
        F.when(F.col("seq") % 2 == 0, F.array(F.lit("from_address_bar"))).alias("transitionQualifiers"),
        "navigation_kind",
    )


def nav_dirty(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Navigation events, most with one field broken."""
    rows = nav_events(spark, sf_dir, events)
    qualifiers = (
        F.when(F.col("seq") % 17 == 8, F.array_repeat(F.lit("q"), 17))
        .when(F.col("seq") % 17 == 9, F.array(F.lit("a"), F.lit("")))
        .otherwise(F.array(F.lit("from_address_bar")))
    )
    return rows.select(
        "seq", *[F.expr(text).alias(name) for name, text in DIRTY_SQL.items()],
        qualifiers.alias("transition_qualifiers"),
    )


def rep_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PhishTank-shaped feed with mixed truth words."""
    return pages(spark, sf_dir).select(
        "url", F.expr("CASE WHEN page_id % 5 = 0 THEN 'true' ELSE 'false' END").alias("in_database"),
        F.expr("CASE WHEN page_id % 10 = 0 THEN 'Y' ELSE 'n' END").alias("verified"),
        F.expr("CASE WHEN page_id % 20 = 0 THEN 'yes' ELSE 'no' END").alias("valid"),
        F.col("page_id").alias("phish_id"),
        F.concat(F.lit("detail/"), F.col("page_id").cast("string")).alias("phish_detail_page"),
    )


def webrisk_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threat answers for every 15th page; some expired, malformed or of an unwanted type."""
    rows = pages(spark, sf_dir).filter(F.col("page_id") % 15 == 0)
    kinds = F.expr(
        "CASE page_id % 4 WHEN 0 THEN array(' social_engineering', 'SOCIAL_ENGINEERING') WHEN 1 THEN array('MALWARE') "
        "WHEN 2 THEN array('SOCIAL_ENGINEERING', 'MALWARE') ELSE array('POTENTIALLY_HARMFUL') END"
    )
    expiry = F.expr(
        "CASE page_id % 7 WHEN 0 THEN '2024-01-15T00:00:00Z' WHEN 1 THEN '2024-03-01 00:00:00' "
        "WHEN 2 THEN '2024-03-01T02:00:00.123456789+02:00' ELSE '2024-03-01T00:00:00Z' END"
    )
    return rows.select("page_id", "url", kinds.alias("threat_types_raw"), expiry.alias("expire_time"))


def registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration dates per host, from the digits of its hash; some hosts and dates missing."""
    hosts = pages(spark, sf_dir).select(F.expr(HOST_SQL).alias("host")).distinct()
    digest = F.md5("host")
    number = lambda start: F.conv(F.substring(digest, start, 2), 16, 10).cast("int")
    created = F.date_sub(F.lit("2024-01-01").cast("date"), number(2) * 20)
    expires = F.date_add(created, number(4) * 4)
    return hosts.filter(F.substring(digest, 1, 1) != "0").select(
        "host",
        F.when(F.substring(digest, 8, 1) != "0", created.cast("timestamp")).alias("creation_date"),
        F.when(F.substring(digest, 9, 1) != "0", expires.cast("timestamp")).alias("expiration_date"),
    )


def lookup_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One lookup per event: provider, outcome, verdict flags and match expiry."""
    rows = nav_events(spark, sf_dir, events)
    listed = F.col("page_id") % 5 == 0
    outcome = F.when(F.col("event_type") == "error", "error").when(listed, "match").otherwise("none")
    return rows.select(
        "seq", "event_id", F.col("ts_s").alias("ts"), "url", "page_id", "agent_id", "event_type", "value",
        F.when(F.col("seq") % 2 == 0, fv.PHISHTANK).otherwise(fv.WEB_RISK).alias("provider"),
        outcome.alias("outcome"),
        (F.lit(1705276800) + (F.col("page_id") % 3) * 864000).alias("expire_at"),
    )


def labeled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from host names and page numbers, with repeats that contradict."""
    rows = pages(spark, sf_dir)
    positive = F.col("url").rlike("cheap-pills|spam-farm") | (F.col("page_id") % 6 == 1)
    base = rows.select("page_id", "url", positive.cast("int").alias("label"))
    again = base.filter(F.col("page_id") % 40 == 0).withColumn("label", 1 - F.col("label"))
    return base.unionByName(again)


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with verification words, repeats and unusable URLs; `pos` is the file order."""
    rows = messy_pages(spark, sf_dir)
    words = F.expr("CASE page_id % 7 WHEN 0 THEN 'yes' WHEN 1 THEN '' WHEN 2 THEN ' NO ' ELSE 'unverified' END")
    first = rows.select(F.col("page_id").alias("pos"), "page_id", "url", words.alias("verified"))
    again = first.filter(F.col("page_id") % 5 == 0).withColumn("pos", F.col("pos") + 1000000000)
    return first.unionByName(again)


def with_score(df: DataFrame, url: str = "url") -> DataFrame:
    """Lexical score of each row's URL and the columns a model reports with it."""
    from urlvane.operators.features import url_features_modern

    scored = url_features_modern(df, url).withColumns({
        "score": F.when(F.col("feature_error").isNull(), F.expr(SCORE_SQL)), "threshold": F.lit(SCORE_THRESHOLD),
        "model_version": F.lit("linear-1"), "model_kind": F.lit(fv.MODEL_KIND), "calibrated": F.lit(True),
    })
    return scored.drop(*fv.MODERN_FEATURES, "feature_error")
