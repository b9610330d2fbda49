"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from urlvane import fixed_values as fv, schemas
from urlvane.functions import times, urls
from urlvane.operators import (
    alerts, classify, correlate, features, guards, metrics, navigation, reputation, selection,
)
from urlvane.plans import inputs
from urlvane.settings import Settings
from urlvane.sources import navigation as nav_source, sinks, url_lists

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

ML_ON = Settings(ml_enabled=True, threshold=inputs.SCORE_THRESHOLD)
WEB_RISK_TYPES = ("SOCIAL_ENGINEERING", "MALWARE")
QUOTA = 1500
GUARDS = Settings(provider=fv.WEB_RISK, circuit_s=3600, monthly_limit=1000)
ML_GUARDS = Settings(provider=fv.WEB_RISK, circuit_s=3600, monthly_limit=1500, ml_enabled=True, threshold=inputs.SCORE_THRESHOLD)
DEDUP_WINDOW_MS = 3_600_000


def query(function):
    REGISTRY[function.__name__] = function
    return function


def _rounded(df: DataFrame, names: list[str], places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# --- URL functions ---------------------------------------------------------

@query
def url_split(spark, sf):
    df = urls.with_url_parts(inputs.messy_pages(spark, sf))
    keep = ["scheme", "netloc", "host", "port_text", "path", "query", "fragment"]
    return df.select("page_id", *[F.col("u_" + n).alias(n) for n in keep],
                     F.col("u_username").alias("username"), F.col("u_password").alias("password"),
                     urls.is_web().alias("is_web"))


@query
def filter_web_urls(spark, sf):
    return navigation.filter_web_urls(inputs.messy_pages(spark, sf))


@query
def normalize_url_canonical(spark, sf):
    return urls.canonical_url(inputs.messy_pages(spark, sf)).select(
        "page_id", "canonical_url", "canonical_host", "url_error"
    )


@query
def normalize_url_browser(spark, sf):
    return urls.browser_url(inputs.messy_pages(spark, sf)).select("page_id", "browser_url", "browser_host")


@query
def redact_query(spark, sf):
    df = urls.with_url_parts(inputs.messy_pages(spark, sf))
    return df.filter(urls.is_web_url("url")).select(
        "page_id", urls.canonical_query(F.col("u_query"), F.col("u_host")).alias("sorted_query"),
        urls.browser_query(F.col("u_query"), F.col("u_host")).alias("kept_query"),
    )


@query
def is_search_host(spark, sf):
    df = urls.with_url_parts(inputs.messy_pages(spark, sf))
    return df.groupBy("u_host").agg(F.count("*").alias("pages")).select(
        F.col("u_host").alias("host"), urls.is_search_host("u_host").alias("search_host"),
        urls.is_ip_host("u_host").alias("ip_host"), "pages",
    )


@query
def is_ip_host(spark, sf):
    df = urls.with_url_parts(inputs.messy_pages(spark, sf))
    return df.filter(urls.is_ip_host("u_host")).select("page_id", F.col("u_host").alias("host"))


@query
def build_nav_event(spark, sf):
    details = inputs.nav_details(spark, sf)
    events = navigation.build_nav_events(
        details, F.col("navigation_kind"), F.sha2("event_id", 256), F.col("stamp")
    )
    return events.withColumn("transition_qualifiers", F.array_join("transition_qualifiers", ","))


@query
def normalize_timestamp(spark, sf):
    df = inputs.nav_dirty(spark, sf)
    return df.select("seq", "timestamp", times.utc_text("timestamp").alias("utc_text"))


@query
def parse_expire_time(spark, sf):
    df = inputs.webrisk_feed(spark, sf)
    return df.select("page_id", "expire_time", times.expire_epoch("expire_time").alias("expire_at"))


@query
def url_key(spark, sf):
    return inputs.messy_pages(spark, sf).select("page_id", urls.url_key("url").alias("url_key"))


@query
def utc_month(spark, sf):
    df = inputs.nav_events(spark, sf)
    return df.groupBy(times.utc_month("ts_s").alias("month")).agg(F.count("*").alias("events"))


@query
def site_domain(spark, sf):
    df = urls.with_url_parts(inputs.messy_pages(spark, sf))
    return df.select("page_id", urls.site_domain("u_netloc").alias("site_domain"))


@query
def char_entropy(spark, sf):
    return inputs.messy_pages(spark, sf).select("page_id", F.round(urls.char_entropy("url"), 9).alias("entropy"))


@query
def score_percent(spark, sf):
    df = inputs.with_score(inputs.pages(spark, sf))
    return df.select(
        "page_id", "score", F.round(F.col("score") * 100, 2).alias("score_percent"),
        F.abs(F.round(F.round(F.col("score") - 0.5, 2) * 100, 6)).alias("legacy_percent"),
    )


# --- Features --------------------------------------------------------------

@query
def url_features_modern(spark, sf):
    df = features.url_features_modern(inputs.messy_pages(spark, sf))
    return _rounded(df, ["digit_ratio", "character_entropy"]).select("page_id", *fv.MODERN_FEATURES, "feature_error")


@query
def url_features_legacy(spark, sf):
    df = features.url_features_legacy(
        inputs.pages(spark, sf), "url", inputs.registration(spark, sf), inputs.table(spark, sf, "pages"), inputs.NOW
    )
    return df.select("page_id", "site_domain", *fv.LEGACY_FEATURES)


@query
def url_features_legacy_offline(spark, sf):
    df = features.url_features_legacy(inputs.messy_pages(spark, sf))
    return df.select("page_id", "feature_error", *fv.LEGACY_FEATURES)


@query
def page_features(spark, sf):
    df = features.page_features(inputs.table(spark, sf, "pages"))
    return df.select("page_id", "iframe", "mouse_over", "right_click", "web_forwards")


@query
def page_join(spark, sf):
    joined = features.page_join(inputs.messy_pages(spark, sf), inputs.table(spark, sf, "pages"))
    return joined.select("page_id", "iframe", "mouse_over", "right_click", "web_forwards")


@query
def registration_features(spark, sf):
    hosts = inputs.pages(spark, sf).select("page_id", F.expr(inputs.HOST_SQL).alias("host"))
    return features.registration_features(hosts, inputs.registration(spark, sf), inputs.NOW)


@query
def traffic_rank_flag(spark, sf):
    ranked = inputs.registration(spark, sf).select(
        "host", F.conv(F.substring(F.md5("host"), 1, 5), 16, 10).cast("long").alias("rank")
    )
    hosts = inputs.pages(spark, sf).select("page_id", F.expr(inputs.HOST_SQL).alias("host"))
    return features.traffic_rank_flag(hosts, ranked)


# --- Navigation ------------------------------------------------------------

@query
def filter_top_level(spark, sf):
    return navigation.filter_top_level(inputs.nav_details(spark, sf), "frameId").select("seq", "tabId", "url")


@query
def validate_nav_event(spark, sf):
    df = navigation.validate_nav_event(inputs.nav_dirty(spark, sf))
    return df.select("seq", "accepted", "error", "event_id", "url", "url_host", "timestamp")


@query
def split_valid_quarantine(spark, sf):
    valid, rejected = navigation.split_valid_quarantine(navigation.validate_nav_event(inputs.nav_dirty(spark, sf)))
    kept = valid.groupBy(F.lit("accepted").alias("reason")).agg(F.count("*").alias("events"))
    return kept.unionByName(rejected.groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("events")))


@query
def match_nav_rule(spark, sf):
    return navigation.match_nav_rule(inputs.nav_dirty(spark, sf)).select("seq", "url")


@query
def navigation_alerts(spark, sf):
    df = alerts.navigation_alerts(navigation.match_nav_rule(inputs.nav_dirty(spark, sf)))
    return df.withColumn("groups", F.array_join("groups", ","))


@query
def extract_url_from_command(spark, sf):
    """Command lines made of conversation text and a page URL."""
    talk = inputs.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    total = inputs.table(spark, sf, "pages").agg(F.count("*")).scalar()
    talk = talk.withColumn("page_id", (F.col("conv_id") * 7 + F.col("turn")) % total)
    lines = talk.join(inputs.pages(spark, sf), "page_id").select(
        "conv_id", "turn",
        F.when(F.col("turn") % 3 == 2, F.col("text")).otherwise(F.concat_ws(" ", "text", "url", F.lit("--x"))).alias("command"),
    )
    return navigation.extract_url_from_command(lines, "command").select("conv_id", "turn", "url")


@query
def tolerant_jsonl(spark, sf):
    lines = _damaged_lines(spark, sf)
    return nav_source.tolerant_lines(lines).select(
        "event_id", "url", "tab_id"
    )


@query
def nav_stream(spark, sf):
    """A log that grows between two runs of the stream; the second run takes up what came since."""
    from urlvane.plans.scratch import shared_folder
    from urlvane.streaming import pipelines

    folder = shared_folder(spark, "tail")
    lines = _damaged_lines(spark, sf).select("value")
    for half in (0, 1):
        lines.filter(F.crc32("value") % 2 == half).write.mode("append").text(f"{folder}/log")
        rows = nav_source.nav_stream(spark, f"{folder}/log").select("event_id", "url", "tab_id")
        _finish(pipelines.write_stream(rows, f"{folder}/rows", f"{folder}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def _damaged_lines(spark, sf):
    """JSON lines of which some are cut, garbage, followed by more text, in single quotes or of another type."""
    events = inputs.nav_dirty(spark, sf).select("seq", F.to_json(F.struct(*schemas.NAVIGATION.fieldNames())).alias("line"))
    return events.select(
        "seq",
        F.when(F.col("seq") % 10 == 3, F.substring("line", 1, 40)).when(F.col("seq") % 10 == 4, "garbage")
        .when(F.col("seq") % 10 == 5, F.replace("line", F.lit('"tab_id":'), F.lit('"tab_id":"x","t":')))
        .when(F.col("seq") % 40 == 6, F.concat("line", F.lit(" xyz"))).when(F.col("seq") % 40 == 16, F.concat("line", F.lit("}")))
        .when(F.col("seq") % 40 == 26, F.concat("line", F.lit(", {}"))).when(F.col("seq") % 40 == 36, F.lit("{'event_id': 'x'}"))
        .otherwise(F.col("line")).alias("value"),
    )


@query
def parse_nav_lines(spark, sf):
    parsed = navigation.validate_nav_event(navigation.parse_nav_lines(_damaged_lines(spark, sf)))
    return parsed.groupBy(F.coalesce("error", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("events"))


def _alert_lines(spark, sf):
    rows = inputs.nav_dirty(spark, sf)
    alert = F.struct(
        F.concat(F.lit("alert-"), F.col("seq").cast("string")).alias("id"),
        F.struct(F.when(F.col("seq") % 19 == 1, "100999").otherwise(fv.NAVIGATION_RULE_ID).alias("id")).alias("rule"),
        F.when(F.col("seq") % 19 != 2, F.struct(
            (F.col("seq") % 7).cast("string").alias("id"), F.lit("host").alias("name"),
            F.when(F.col("seq") % 3 == 0, "10.0.0.1").alias("ip"),
        )).alias("agent"),
        F.struct("event_type", "source", "browser", "event_id", "url").alias("data"),
    )
    return rows.select("seq", F.when(F.col("seq") % 19 == 3, "[1]").otherwise(F.to_json(alert)).alias("value"))


@query
def parse_alert(spark, sf):
    df = nav_source.parse_alert(_alert_lines(spark, sf))
    return df.select(
        "seq", "alert_error", F.col("rule.id").alias("rule_id"), F.col("agent.id").alias("agent_id"),
        F.col("data.url").alias("url"),
    )


@query
def validate_alert(spark, sf):
    df = navigation.validate_alert(nav_source.parse_alert(_alert_lines(spark, sf)))
    return df.select("seq", "error", "url", "url_host", "source_event_id", "source_alert_id", "source_rule_id",
                     "agent_id", "agent_name", "agent_ip")


@query
def error_result(spark, sf):
    df = navigation.validate_alert(nav_source.parse_alert(_alert_lines(spark, sf)))
    return classify.error_results(df.filter(F.col("error").isNotNull())).groupBy(
        "status", "malicious", "source", "error_type", "error", "url", "source_event_id"
    ).agg(F.count("*").alias("events"))


@query
def route_envelope(spark, sf):
    df = navigation.validate_alert(nav_source.parse_alert(_alert_lines(spark, sf))).filter("error IS NULL")
    payload = F.to_json(F.struct("source_event_id", "url_host"))
    agent = F.when(F.col("agent_id") == "0", "000").otherwise(F.col("agent_id"))
    return df.select("seq", sinks.route_envelope(payload, agent, F.col("agent_name"), F.col("agent_ip")).alias("message"))


@query
def write_results_jsonl(spark, sf):
    df = inputs.nav_events(spark, sf).select("url", "event_id", "tab_id", "document_id")
    return sinks.sorted_json(df)


@query
def dedup_anchored(spark, sf):
    events = inputs.table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", times.epoch_ms("ts").alias("t_ms")
    )
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return navigation.dedup_anchored(events, "t_ms", "event_id", DEDUP_WINDOW_MS, key)


# --- Reputation ------------------------------------------------------------

@query
def truthy(spark, sf):
    df = inputs.rep_feed(spark, sf)
    return df.select("url", *[reputation.truthy(n).alias(n) for n in ("in_database", "verified", "valid")])


@query
def reputation_phishtank(spark, sf):
    df = reputation.reputation_phishtank(inputs.nav_events(spark, sf).select("seq", "url"), _half_feed(spark, sf))
    return df.select("seq", "rep_status", "rep_malicious", "in_database", "verified", "valid", "phish_id", "detail_url")


def _half_feed(spark, sf):
    """The feed without pages that a provider would not know."""
    return inputs.rep_feed(spark, sf).filter(F.col("in_database") == "true")


@query
def reputation_webrisk(spark, sf):
    df = reputation.reputation_webrisk(
        inputs.nav_events(spark, sf).select("seq", "url"), inputs.webrisk_feed(spark, sf),
        F.lit(inputs.NOW_S), WEB_RISK_TYPES,
    )
    return df.select("seq", "rep_status", "rep_malicious", F.array_join("threat_types", ",").alias("threat_types"),
                     "expire_at", "rep_error")


@query
def distinct_keep_order(spark, sf):
    df = inputs.webrisk_feed(spark, sf)
    kinds = F.array_distinct(F.transform("threat_types_raw", lambda x: F.upper(F.trim(x))))
    return df.select("page_id", F.array_join(kinds, ",").alias("threat_types"))


@query
def parse_provider_response(spark, sf):
    """Response bodies per page, a few cut, over-long, or of the wrong shape."""
    rows = inputs.rep_feed(spark, sf)
    good = F.to_json(F.struct(F.struct("in_database", "verified", "valid", "phish_id", "phish_detail_page").alias("results")))
    page = F.col("phish_id")
    body = (
        F.when(page % 11 == 1, F.substring(good, 1, 30)).when(page % 11 == 2, "[1, 2]").when(page % 11 == 3, '{"other": 1}')
        .when(page % 11 == 4, F.concat(good, F.repeat(F.lit(" "), 2000))).otherwise(good)
    )
    df = reputation.parse_provider_response(
        rows.select(page.alias("page_id"), body.alias("body")), fv.PHISHTANK, max_bytes=1024
    )
    return df.select("page_id", "response_error", F.col("response.results.phish_id").alias("phish_id"),
                     F.col("response.results.verified").alias("verified"))


@query
def filter_public_destination(spark, sf):
    """Hosts of pages against a resolution table derived from their hashes."""
    hosts = inputs.pages(spark, sf).select("page_id", F.expr(inputs.HOST_SQL).alias("url_host"))
    digest = F.md5("host")
    octet = lambda start: F.conv(F.substring(digest, start, 2), 16, 10)
    known = inputs.registration(spark, sf).select("host")
    first = known.select("host", F.concat_ws(".", octet(1), octet(3), octet(5), octet(7)).alias("ip"))
    second = known.filter(F.substring(digest, 10, 1) < "4").select(
        "host", F.concat_ws(".", F.lit("192.168"), octet(3), octet(5)).alias("ip")
    )
    return reputation.filter_public_destination(hosts, first.unionByName(second))


# --- Guards ----------------------------------------------------------------

def _log_with_ttl(spark, sf, events=None):
    log = inputs.lookup_log(spark, sf, events)
    match = F.col("outcome") == "match"
    ttl = guards.lookup_ttl(Settings(), F.col("provider"), match, match, F.col("expire_at"), F.col("ts"))
    return log.withColumn("ttl", F.when(F.col("outcome") == "error", 0).otherwise(ttl))


def _replayed(spark, sf):
    return guards.cache_replay(
        _log_with_ttl(spark, sf), ["provider", "url"], "ts", "seq", "ttl", F.col("outcome") == "error"
    )


@query
def cache_replay(spark, sf):
    return _replayed(spark, sf).select("seq", "provider", "ts", "outcome", "ttl", "cache_hit")


@query
def verdict_cache_asof(spark, sf):
    log = _log_with_ttl(spark, sf)
    puts = log.filter("ttl > 0").withColumn("expires_at", F.col("ts") + F.col("ttl")).select(
        "provider", "url", "ts", "seq", "expires_at", "outcome"
    )
    asks = log.select("provider", "url", "ts", "seq")
    return guards.verdict_cache_asof(asks, puts, ["provider", "url"], "ts", "seq", ["outcome"]).select(
        "seq", "cache_hit", F.col("outcome").alias("cached_outcome")
    )


@query
def quota_guard(spark, sf):
    calls = inputs.lookup_log(spark, sf).select("provider", "ts", "seq")
    return guards.quota_guard(calls, QUOTA)


@query
def circuit_open(spark, sf):
    log = inputs.lookup_log(spark, sf).select("provider", "ts", "seq", "outcome")
    return guards.circuit_open(log, 300)


@query
def guarded_lookup(spark, sf):
    log = _log_with_ttl(spark, sf).select("seq", "provider", "url", "ts", "outcome", "ttl")
    return guards.guarded_lookup(log, GUARDS.monthly_limit, GUARDS.circuit_s, [fv.WEB_RISK]).drop("url")


@query
def consecutive_failures(spark, sf):
    log = inputs.lookup_log(spark, sf).select("provider", "ts", "seq", "outcome")
    return guards.consecutive_failures(log)


@query
def monthly_usage(spark, sf):
    log = _replayed(spark, sf).withColumn("blocked", F.lit(False))
    return guards.monthly_usage(log)


@query
def budget_status(spark, sf):
    log = inputs.lookup_log(spark, sf).withColumns({"cache_hit": F.lit(False), "blocked": F.lit(False)})
    return guards.budget_status(guards.monthly_usage(log), 6000)


# --- Classification and alerts ----------------------------------------------

def _repeated_feed(spark, sf):
    """The feed with a third of its listed URLs again, in rows that confirm nothing."""
    feed = inputs.rep_feed(spark, sf)
    return feed.unionByName(feed.filter(F.col("phish_id") % 15 == 0).withColumns({"verified": F.lit("n"), "valid": F.lit("no")}))


def _reputed(spark, sf, events=None):
    """Navigations with a provider verdict, or the reason why there is none."""
    rows = inputs.nav_events(spark, sf, events).select("seq", "event_id", "url", "event_type", "value")
    df = reputation.reputation_phishtank(rows, _repeated_feed(spark, sf))
    df = urls.with_url_parts(df, "url", "_h_").withColumn("url_host", F.col("_h_host"))
    df = urls.drop_url_parts(df, "_h_")
    failed = F.col("event_type") == "error"
    return df.withColumns({
        "rep_failure": F.when(failed & (F.col("seq") % 3 == 0), "quota_guard")
        .when(failed & (F.col("seq") % 3 == 1), "circuit_open").when(failed, "error"),
        "rep_error": F.when(failed, "lookup failed"),
    })


def classified(spark, sf, settings=ML_ON, events=None):
    df = _reputed(spark, sf, events)
    confirmed = F.col("rep_failure").isNull() & F.col("rep_malicious")
    if settings.ml_enabled and df.isStreaming:
        df = classify.score_unconfirmed(df, inputs.with_score, confirmed)
    elif settings.ml_enabled:
        df = classify.score_distinct(df, inputs.with_score)
    return classify.classify_navigation(df, settings, fv.PHISHTANK)


@query
def classify_navigation(spark, sf):
    return classified(spark, sf).select(
        "seq", "status", "malicious", "source", "degraded", "reputation_status", "reputation_error",
        "ml_status", "error", "error_type", "score", "threshold", "review_threshold", "phish_id",
    )


def _guarded(spark, sf, settings):
    """Navigations after the whole guard chain of the Web Risk provider, with the answer or the reason why there is none."""
    rows = inputs.nav_events(spark, sf).select("seq", "event_id", "url", "page_id", "event_type", F.col("ts_s").alias("ts"))
    df = reputation.reputation_webrisk(rows, inputs.webrisk_feed(spark, sf).drop("page_id"), F.lit(inputs.NOW_S), WEB_RISK_TYPES)
    failed = (F.col("event_type") == "error") | F.col("rep_error").isNotNull()
    outcome = F.when(failed, "error").when(F.col("rep_malicious"), "match").otherwise("none")
    df = df.withColumns({"provider": F.lit(fv.WEB_RISK), "outcome": outcome})
    ttl = guards.lookup_ttl(settings, F.col("provider"), F.col("rep_malicious"), F.col("in_database"), F.col("expire_at"), F.col("ts"))
    df = df.withColumn("ttl", F.when(failed, 0).otherwise(ttl).cast("long"))
    df = guards.guarded_lookup(df, settings.monthly_limit, settings.circuit_s, [fv.WEB_RISK])
    df = urls.with_url_parts(df, "url", "_h_").withColumn("url_host", F.col("_h_host"))
    df = urls.drop_url_parts(df, "_h_")
    decision = F.col("decision")
    return df.withColumns({
        "cache_hit": decision == "cache_hit",
        "rep_failure": F.when(decision.isin("circuit_open", "quota_guard", "error"), decision),
        "rep_error": F.when(decision == "circuit_open", fv.CIRCUIT_TEXT).when(decision == "quota_guard", fv.QUOTA_TEXT)
        .when(decision == "error", F.coalesce("rep_error", F.lit(fv.REQUEST_TEXT))),
        "threat_types": F.array_join("threat_types", ","),
    })


@query
def classify_webrisk(spark, sf):
    """The whole event: guards, decision table and the nested classification, here with its fields side by side."""
    df = classify.score_distinct(_guarded(spark, sf, ML_GUARDS), inputs.with_score)
    df = classify.classify_navigation(df, ML_GUARDS, fv.WEB_RISK)
    events = classify.classification_events(df.withColumnRenamed("event_id", "source_event_id"), [
        "seq", "url", "url_host", "source_event_id", "cache_hit", "status", "malicious", "source", "reputation_provider", "degraded",
        "reputation_status", "reputation_error", "ml_status", "error", "score", "threshold",
    ])
    return events.select("integration", "schema_version", "classification.*")


@query
def classify_disabled(spark, sf):
    """Without a provider every verdict is the model's, and marked as degraded."""
    rows = inputs.nav_events(spark, sf).select("seq", "url")
    none = rows.withColumns({
        "rep_status": F.lit(None).cast("string"), "rep_malicious": F.lit(False), "rep_failure": F.lit("error"), "rep_error": F.lit(fv.DISABLED_TEXT)})
    df = classify.classify_navigation(classify.score_distinct(none, inputs.with_score), ML_ON, "disabled")
    return df.select("seq", "status", "malicious", "source", "degraded", "reputation_provider", "reputation_status", "reputation_error",
                     "ml_status", "error", "score")


@query
def classify_navigation_no_ml(spark, sf):
    return classified(spark, sf, Settings()).select("seq", "status", "malicious", "source", "error", "error_type")


@query
def ml_band(spark, sf):
    df = inputs.with_score(inputs.messy_pages(spark, sf))
    band = classify.ml_band(F.col("score"), F.col("threshold"), F.lit(fv.REVIEW_THRESHOLD))
    return df.select("page_id", "score", band.alias("band"))


@query
def assign_alerts(spark, sf):
    df = alerts.assign_alerts(classified(spark, sf), fv.PHISHTANK)
    return df.select("seq", "role", "rule_id", "level", F.array_join("groups", ",").alias("groups"), "technique",
                     F.when(F.col("role").isin("ml", "review"), F.regexp_replace("description", " with score .*", ""))
                     .otherwise(F.col("description")).alias("description"))


@query
def emit_alerts(spark, sf):
    df = alerts.emit_alerts(alerts.assign_alerts(classified(spark, sf), fv.PHISHTANK))
    return df.groupBy("role", "level").agg(F.count("*").alias("alerts"))


@query
def staging_alerts(spark, sf):
    df = alerts.emit_alerts(alerts.assign_alerts(classified(spark, sf), fv.PHISHTANK, staging=True))
    return df.groupBy("role", "level").agg(F.count("*").alias("alerts"))


@query
def alert_policy_join(spark, sf):
    df = alerts.assign_alerts(classified(spark, sf), fv.PHISHTANK)
    return df.groupBy("role", "rule_id", "level", "technique").agg(F.count("*").alias("events"))


def flagship(spark, sf):
    """Events to verdicts to alert levels, counted."""
    df = alerts.assign_alerts(classified(spark, sf), fv.PHISHTANK)
    return df.groupBy("status", "source", "level").agg(
        F.count("*").alias("events"), F.countDistinct("url_host").alias("hosts"),
        F.round(F.max("score"), 6).alias("top_score"),
    )


@query
def flagship_alert_levels(spark, sf):
    return flagship(spark, sf)


@query
def provider_exclusive(spark, sf):
    return correlate.provider_exclusive(classified(spark, sf), fv.PHISHTANK)


# --- Lists, samples and labels ---------------------------------------------

@query
def read_urls_text(spark, sf):
    rows = inputs.messy_pages(spark, sf)
    lines = rows.select("page_id", F.explode(F.array(
        F.concat(F.lit("  "), "url", F.lit(" \t")), F.concat(F.lit("# "), "url"), F.lit("   "),
    )).alias("value"))
    return url_lists.url_lines(lines).select("page_id", "url")


@query
def valid_sample_url(spark, sf):
    df = selection.valid_sample_url(inputs.messy_pages(spark, sf))
    return df.filter("sample_ok").select("page_id", "sample_url", "sample_host")


@query
def filter_unverified(spark, sf):
    return selection.filter_unverified(inputs.url_list(spark, sf)).select("pos", "url")


@query
def first_occurrence(spark, sf):
    df = inputs.url_list(spark, sf).select("pos", "url")
    from urlvane.operators.ordered import first_rows

    return first_rows(df, ["url"], "pos", "first")


@query
def selection_reasons(spark, sf):
    return selection.select_samples(inputs.url_list(spark, sf), 60).select("pos", "reason")


@query
def selection_counts(spark, sf):
    return selection.selection_counts(selection.select_samples(inputs.url_list(spark, sf), 60))


@query
def limit_accepted(spark, sf):
    df = selection.select_samples(inputs.url_list(spark, sf), 40)
    return df.filter(F.col("reason") == "selected").select("pos", "sample_url", "sample_host")


def evaluated(spark, sf):
    """List rows selected, scored as not found, and banded."""
    chosen = selection.select_samples(inputs.url_list(spark, sf), limit=None).filter(F.col("reason") == "selected")
    df = chosen.select("pos", F.col("sample_url").alias("url"), F.col("sample_host").alias("url_host"))
    none = F.lit(None).cast("string")
    df = inputs.with_score(df).withColumns({
        "rep_status": F.lit("not_found"), "rep_malicious": F.lit(False), "rep_failure": none, "rep_error": none,
    })
    return classify.classify_navigation(df, ML_ON, fv.PHISHTANK)


@query
def evaluate_list(spark, sf):
    return evaluated(spark, sf).select("pos", "url", "url_host", "status", "score", "threshold", "model_kind", "calibrated")


@query
def evaluation_summary(spark, sf):
    return metrics.evaluation_summary(evaluated(spark, sf))


@query
def quality_gate(spark, sf):
    return metrics.quality_gate(metrics.evaluation_summary(evaluated(spark, sf)), 0.9)


@query
def sample_n(spark, sf):
    labels = selection.dedupe_labels(inputs.labeled_urls(spark, sf)).filter("NOT conflict").select("url", "label")
    return selection.sample_n(labels, 30, "url", ["label"])


@query
def dedupe_labels(spark, sf):
    return selection.dedupe_labels(inputs.labeled_urls(spark, sf))


@query
def class_counts(spark, sf):
    rows = selection.dedupe_labels(inputs.labeled_urls(spark, sf)).filter("NOT conflict")
    return selection.class_counts(rows)


@query
def training_guard(spark, sf):
    rows = selection.dedupe_labels(inputs.labeled_urls(spark, sf)).filter("NOT conflict")
    return selection.training_guard(rows)


@query
def stratified_split(spark, sf):
    from urlvane.ml.training import stratified_split as split

    rows = selection.dedupe_labels(inputs.labeled_urls(spark, sf)).filter("NOT conflict").select("url", "label")
    return split(rows)


@query
def union_labeled(spark, sf):
    rows = inputs.labeled_urls(spark, sf)
    part = lambda label: rows.filter(F.col("label") == label).select("url")
    both = selection.union_labeled(part(0), part(1))
    return both.groupBy("url", "label").agg(F.count("*").alias("copies"))


#: URLs sampled per label; the sample is the feature.
FEATURE_SAMPLE = 5000


@query
def build_feature_dataset(spark, sf):
    rows = selection.dedupe_labels(inputs.labeled_urls(spark, sf)).filter("NOT conflict").select("url", "label")
    return selection.feature_dataset(
        rows, FEATURE_SAMPLE, inputs.registration(spark, sf), inputs.table(spark, sf, "pages"), inputs.NOW
    ).withColumnRenamed("Prefix/Suffix", "Prefix_Suffix")


# --- Metrics ---------------------------------------------------------------

@query
def outcome_counters(spark, sf):
    df = navigation.validate_nav_event(inputs.nav_dirty(spark, sf))
    return metrics.outcome_counters(df.select(F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("outcome")))


def _scored_labels(spark, sf):
    rows = selection.dedupe_labels(inputs.labeled_urls(spark, sf)).filter("NOT conflict").select("url", "label")
    return inputs.with_score(rows).select("url", "label", "score")


@query
def classification_report(spark, sf):
    return metrics.classification_report(_scored_labels(spark, sf), inputs.SCORE_THRESHOLD)


@query
def roc_auc(spark, sf):
    return metrics.roc_auc(_scored_labels(spark, sf))


@query
def dataset_fingerprint(spark, sf):
    """Of the pages with every fifth row twice."""
    rows = inputs.table(spark, sf, "pages").select("page_id", "url", "html")
    return metrics.dataset_fingerprint(rows.unionByName(rows.filter(F.col("page_id") % 5 == 0)))


@query
def tail_n(spark, sf):
    return correlate.tail_n(inputs.nav_dirty(spark, sf), ["seq"]).select("seq", "event_type", "url")


@query
def log_health(spark, sf):
    return metrics.log_health(correlate.tail_n(inputs.nav_dirty(spark, sf), ["seq"]))


@query
def pipeline_metrics(spark, sf):
    hits = _replayed(spark, sf).select("seq", "provider", "url", "outcome", "cache_hit", "value")
    verdicts = classified(spark, sf).select("seq", "source", "degraded")
    joined = hits.join(verdicts, "seq").withColumn("latency_ms", F.floor(F.col("value") * 10))
    return metrics.pipeline_metrics(joined)


@query
def threat_types_seen(spark, sf):
    df = reputation.reputation_webrisk(
        inputs.nav_events(spark, sf).select("seq", "url"), inputs.webrisk_feed(spark, sf),
        F.lit(inputs.NOW_S), WEB_RISK_TYPES,
    )
    return metrics.threat_types_seen(df)


@query
def lookup_projection(spark, sf):
    return metrics.lookup_projection(inputs.nav_events(spark, sf), 0.75, 0.02)


@query
def repeat_windows(spark, sf):
    return metrics.repeat_windows(inputs.nav_events(spark, sf))


# --- Correlation -----------------------------------------------------------

def _classification_log(spark, sf):
    """Classifications of two of three events, some written twice; `pos` is the file order."""
    done = classified(spark, sf).filter(F.col("seq") % 3 != 2).select(
        F.col("event_id").alias("source_event_id"), "status", F.col("seq").alias("pos")
    )
    again = done.filter(F.col("pos") % 9 == 0).withColumns({
        "pos": F.col("pos") + 1000000000, "status": F.lit("repeated"),
    })
    return done.unionByName(again)


def _with_agent(spark, sf):
    return inputs.nav_events(spark, sf).select("event_id", "agent_id")


@query
def correlate_events(spark, sf):
    return correlate.correlate_events(_with_agent(spark, sf), _classification_log(spark, sf))


@query
def correlate_events_last(spark, sf):
    return correlate.correlate_events(_with_agent(spark, sf), _classification_log(spark, sf), last=True)


@query
def first_match_per_id(spark, sf):
    return correlate.first_match_per_id(_classification_log(spark, sf), "source_event_id", "pos")


@query
def unclassified_events(spark, sf):
    return correlate.unclassified_events(_with_agent(spark, sf), _classification_log(spark, sf))


@query
def archived_not_alerted(spark, sf):
    rows = inputs.nav_dirty(spark, sf)
    ids = lambda df: df.select(F.concat(F.lit("evt-"), F.col("seq").cast("string")).alias("event_id"))
    alerted = navigation.validate_nav_event(rows).filter("accepted")
    return correlate.archived_not_alerted(ids(rows), ids(navigation.match_nav_rule(rows)), ids(alerted))


@query
def retain_latest_n(spark, sf):
    rows = inputs.nav_events(spark, sf).select("seq", "agent_id", "ts_ms")
    return correlate.retain_latest_n(rows, "agent_id", "ts_ms", "seq", 500)


@query
def dropped_counts(spark, sf):
    return correlate.dropped_counts(inputs.nav_events(spark, sf).select("agent_id"), "agent_id", 500)


# --- Models ----------------------------------------------------------------

# A small regressor over the legacy features, standing in for weights that come from elsewhere.
REGRESSOR_MEAN = [0.5] * 15
REGRESSOR_SCALE = [2.0] * 15
REGRESSOR_VECTORS = [[0.0] * 15, [1.0] * 15, [float(i % 2) for i in range(15)]]
REGRESSOR_WEIGHTS = [0.9, -1.4, 0.35]
REGRESSOR_INTERCEPT, REGRESSOR_GAMMA = -0.2, 0.125


@query
def score_raw_regressor(spark, sf):
    from urlvane.ml.kernel import KernelRegressor, score_raw_regressor as score

    rows = features.url_features_legacy(
        inputs.pages(spark, sf), "url", inputs.registration(spark, sf), inputs.table(spark, sf, "pages"), inputs.NOW
    ).filter(F.col("feature_error").isNull())
    model = KernelRegressor(REGRESSOR_MEAN, REGRESSOR_SCALE, REGRESSOR_VECTORS, REGRESSOR_WEIGHTS,
                            REGRESSOR_INTERCEPT, REGRESSOR_GAMMA)
    return score(rows, model).select(
        "page_id", F.round("score", 9).alias("score"), "threshold", "model_kind", "calibrated",
        (F.col("score") >= F.col("threshold")).alias("suspicious"),
    )


@query
def train_url_model(spark, sf):
    """Train on the labelled pages and score every page with the calibrated model."""
    from urlvane.ml import training

    model, metadata = training.train_url_model(inputs.labeled_urls(spark, sf), "v1", 0.5)
    rows = features.url_features_modern(inputs.messy_pages(spark, sf))
    return training.score_modern(rows, model, metadata).select(
        "page_id", "score", "score_percent", "threshold", "model_version", "model_kind", "calibrated", "feature_error"
    )


# --- Streams: the event table read as a stream, results read back ------------

def _finish(running) -> None:
    running.awaitTermination()


def _streamed(spark, df, name, mode="append"):
    from urlvane.plans.scratch import shared_folder
    from urlvane.streaming import pipelines

    folder = shared_folder(spark, name)
    _finish(pipelines.write_stream(df, f"{folder}/rows", f"{folder}/checkpoint", mode))
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


@query
def stream_validate(spark, sf):
    from urlvane.plans.scratch import shared_folder
    from urlvane.streaming import pipelines

    folder = shared_folder(spark, "validate")
    events = inputs.nav_dirty(spark, sf, inputs.event_stream(spark, sf))
    _finish(pipelines.stream_validate(events, f"{folder}/accepted", f"{folder}/rejected", f"{folder}/checkpoint"))
    fine = spark.read.parquet(f"{folder}/accepted").select(F.lit("accepted").alias("reason"))
    refused = spark.read.parquet(f"{folder}/rejected").select(F.col("error").alias("reason"))
    return fine.unionByName(refused).groupBy("reason").agg(F.count("*").alias("events"))


@query
def stream_dedup(spark, sf):
    from urlvane.streaming import pipelines

    events = inputs.event_stream(spark, sf).select(
        "event_id", "user_id", "event_type", times.epoch_ms("ts").alias("t_ms"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    kept = pipelines.stream_dedup(events, "event_time", "t_ms", "event_id", key, DEDUP_WINDOW_MS)
    return _streamed(spark, kept.drop("event_time"), "dedup")


@query
def stream_cache(spark, sf):
    from urlvane.streaming import pipelines

    log = _log_with_ttl(spark, sf, inputs.event_stream(spark, sf)).withColumn("event_time", F.timestamp_seconds("ts"))
    log = log.select("seq", "provider", "url", "ts", "outcome", "ttl", "event_time")
    flagged = pipelines.stream_cache(log, "event_time", "ts", "seq", "ttl", F.col("outcome") == "error")
    return _streamed(spark, flagged.select("seq", "provider", "ts", "outcome", "ttl", "cache_hit"), "cache")


@query
def stream_guards(spark, sf):
    from urlvane.plans.scratch import shared_folder
    from urlvane.streaming import pipelines

    folder = shared_folder(spark, "guards")
    log = inputs.lookup_log(spark, sf, inputs.event_stream(spark, sf)).select("provider", "ts", "seq", "outcome")
    _finish(pipelines.stream_guards(log, QUOTA, 300, f"{folder}/rows", f"{folder}/state", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/rows").select("provider", "month", "ts", "seq", "outcome", "open", "allowed")


@query
def stream_classify(spark, sf):
    verdicts = classified(spark, sf, events=inputs.event_stream(spark, sf))
    df = alerts.emit_alerts(alerts.assign_alerts(verdicts, fv.PHISHTANK))
    return _streamed(spark, df.select("seq", "status", "source", "role", "level"), "classify")


@query
def stream_correlate(spark, sf):
    """Each event with its classification, which appears up to 20 minutes later or never."""
    from urlvane.streaming import pipelines

    rows = inputs.event_stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("nav_time"))
    results = inputs.event_stream(spark, sf).filter(F.col("event_id") % 3 != 2).select(
        F.col("event_id").alias("source_event_id"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=(F.col("event_id") % 40) * 30)).alias("result_time"),
    )
    joined = pipelines.stream_correlate(rows, results)
    found = joined.filter(F.col("source_event_id").isNotNull())
    return _streamed(spark, found.select("event_id", F.unix_seconds("result_time").alias("result_s")), "correlate")


@query
def stream_repeat_windows(spark, sf):
    """Counts are written as they change; the last one per window and URL is the result."""
    from urlvane.plans.scratch import shared_folder
    from urlvane.streaming import pipelines

    folder = shared_folder(spark, "windows")
    counts = pipelines.stream_repeat_windows(inputs.nav_events(spark, sf, inputs.event_stream(spark, sf)))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
    _finish(pipelines.write_batches(counts, write, f"{folder}/checkpoint", "update"))
    rows = spark.read.schema("window_start_s long, url string, visits long, batch int").parquet(f"{folder}/rows")
    return rows.groupBy("window_start_s", "url").agg(F.max_by("visits", "batch").alias("visits"))
