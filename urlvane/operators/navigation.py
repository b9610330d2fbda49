"""Navigation events: capture, validation, quarantine, rule match and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from urlvane import fixed_values as fv, schemas
from urlvane.functions import times, urls
from urlvane.functions.columns import STRICT_JSON, is_one_object, settle
from urlvane.operators.ordered import anchored_windows


def filter_web_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.filter(urls.is_web_url(url))


def filter_top_level(df: DataFrame, frame: str = "frame_id") -> DataFrame:
    return df.filter(F.col(frame) == 0)


def build_nav_events(details: DataFrame, kind: Column, event_id: Column, timestamp: Column) -> DataFrame:
    """Browser details to navigation events; sub-frames and non-web URLs are dropped.

    `event_id` and `timestamp` are supplied so that a re-run gives the same rows.
    """
    kept = urls.browser_url(details.filter(F.col("frameId") == 0), "url", "_url", "_host")
    return kept.filter(F.col("_url").isNotNull()).select(
        F.lit(fv.SCHEMA_VERSION).alias("schema_version"),
        F.lit(fv.EVENT_TYPE).alias("event_type"),
        event_id.alias("event_id"),
        timestamp.alias("timestamp"),
        F.lit(fv.BROWSER).alias("browser"),
        F.col("_url").alias("url"),
        F.col("_host").alias("url_host"),
        F.col("tabId").alias("tab_id"),
        F.when(F.col("documentId") != "", F.col("documentId")).alias("document_id"),
        kind.alias("navigation_kind"),
        F.coalesce("transitionType", F.lit("unknown")).alias("transition_type"),
        F.coalesce("transitionQualifiers", F.array().cast("array<string>")).alias("transition_qualifiers"),
        F.lit(fv.EVENT_SOURCE).alias("source"),
    )


def _short(text: Column, limit: int) -> Column:
    """Present, not empty and within `limit` bytes."""
    return F.coalesce((F.octet_length(text) > 0) & (F.octet_length(text) <= limit), F.lit(False))


def validate_nav_event(df: DataFrame) -> DataFrame:
    """Add `error` (first failing check), and the normalized url, url_host and timestamp.

    A `_corrupt` or `_mistyped` column, where present, marks rows a reader could not decode.
    """
    df = urls.canonical_url(df, "url", "_url", "_host", "_url_error")
    df = df.withColumn("_time", times.utc_text("timestamp"))
    c = F.col
    no = lambda condition: ~F.coalesce(condition, F.lit(False))
    qualifiers = F.coalesce(c("transition_qualifiers"), F.array().cast("array<string>"))
    checks = [
        ("unsupported schema_version", no(c("schema_version") == fv.SCHEMA_VERSION)),
        ("unsupported event_type", no(c("event_type") == fv.EVENT_TYPE)),
        ("invalid event_id", ~_short(c("event_id"), fv.MAX_ID_LENGTH)),
        ("invalid event source", no((c("browser") == fv.BROWSER) & (c("source") == fv.EVENT_SOURCE))),
        ("invalid tab_id", F.coalesce(c("tab_id"), F.lit(0)) < 0),
        ("document_id is too long", F.coalesce(F.octet_length("document_id"), F.lit(0)) > fv.MAX_ID_LENGTH),
        ("invalid navigation_kind", no(c("navigation_kind").isin(fv.NAVIGATION_KINDS))),
        ("invalid transition_type", ~_short(c("transition_type"), fv.MAX_TRANSITION_LENGTH)),
        ("too many transition_qualifiers", F.size(qualifiers) > fv.MAX_QUALIFIERS),
        ("invalid transition_qualifier", F.exists(qualifiers, lambda q: ~_short(q, fv.MAX_TRANSITION_LENGTH))),
        ("invalid timestamp", c("_time").isNull()),
    ]
    if "_mistyped" in df.columns:
        checks.insert(0, ("message fields have invalid types", c("_mistyped")))
    if "_corrupt" in df.columns:
        checks.insert(0, ("message is not valid JSON", c("_corrupt").isNotNull()))
    error = F.when(checks[0][1], checks[0][0])
    for reason, failed in checks[1:]:
        error = error.when(failed, reason)
    supplied = F.coalesce(c("url_host"), F.lit(""))
    error = error.when(c("_url_error").isNotNull(), c("_url_error")).when(
        (supplied != "") & (F.lower(supplied) != c("_host")), "url_host does not match URL"
    )
    df = settle(df, {"error": error})
    fine = c("error").isNull()
    return df.withColumns({
        "accepted": fine,
        "url": F.when(fine, c("_url")).otherwise(c("url")),
        "url_host": F.when(fine, c("_host")).otherwise(c("url_host")),
        "timestamp": F.when(fine, c("_time")).otherwise(c("timestamp")),
    }).drop("_url", "_host", "_url_error", "_time")


def split_valid_quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted events, and one rejection row (event_id, error) per refused event."""
    return (
        validated.filter("accepted").drop("accepted", "error"),
        validated.filter("NOT accepted").select("accepted", "event_id", "error"),
    )


def acknowledgements(validated: DataFrame) -> DataFrame:
    return validated.select("accepted", "event_id", "error")


def parse_nav_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Decode one JSON event per line, telling broken JSON from wrong field types."""
    loose = F.when(is_one_object(value), F.from_json(F.col(value), "map<string,string>", {"mode": "PERMISSIVE", **STRICT_JSON}))
    wide = schemas.with_corrupt(schemas.NAVIGATION, "_bad")
    strict = F.from_json(F.col(value), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", **STRICT_JSON})
    df = lines.withColumns({"_loose": loose, "_event": strict})
    corrupt = F.when(F.col("_loose").isNull(), F.col(value))
    mistyped = F.col("_loose").isNotNull() & F.col("_event._bad").isNotNull()
    names = schemas.NAVIGATION.fieldNames()
    fields = {n: F.col(f"_event.{n}") for n in names}
    fields["event_id"] = F.coalesce(fields["event_id"], F.col("_loose")["event_id"])
    values = {n: fields[n] for n in names}
    return settle(df, {**values, "_corrupt": corrupt, "_mistyped": mistyped}).select(*names, "_corrupt", "_mistyped")


def validate_alert(df: DataFrame, rule_id: str = fv.NAVIGATION_RULE_ID) -> DataFrame:
    """Check nested alerts (rule, agent, data); adds `error` and the flat navigation columns."""
    df = urls.with_url_parts(df.withColumn("_url", F.col("data.url")), "_url", "_a_")
    same = lambda column, value: F.coalesce(F.col(column) == value, F.lit(False))
    event_id = F.col("data.event_id")
    error = (
        F.when(F.col("rule.id").isNull() | F.col("data").isNull() | F.col("agent").isNull(),
               "alert is missing required fields")
        .when(~same("rule.id", rule_id), f"alert did not originate from navigation rule {rule_id}")
        .when(~same("data.event_type", fv.EVENT_TYPE), "alert is not a browser_navigation event")
        .when(~(same("data.source", fv.EVENT_SOURCE) & same("data.browser", fv.BROWSER)),
              "alert has an unexpected navigation source")
        .when(F.col("_url").isNull() | (F.length("_url") > fv.MAX_URL_LENGTH), "alert URL is missing or too long")
        .when(~urls.is_web("_a_"), "alert URL is not HTTP or HTTPS")
        .when(urls.has_credentials("_a_"), "alert URL contains credentials")
        .when(event_id.isNull() | (event_id == "") | (F.length(event_id) > fv.MAX_ID_LENGTH),
              "alert event_id is invalid")
    )
    df = settle(df, {"error": error})
    ok = lambda value: F.when(F.col("error").isNull(), value)
    return df.select(
        "*",
        ok(F.col("_url")).alias("url"),
        ok(F.col("_a_host")).alias("url_host"),
        ok(event_id).alias("source_event_id"),
        ok(F.coalesce("id", F.lit(""))).alias("source_alert_id"),
        ok(F.col("rule.id")).alias("source_rule_id"),
        F.coalesce("agent.id", F.lit("")).alias("agent_id"),
        F.coalesce("agent.name", F.lit("")).alias("agent_name"),
        F.coalesce("agent.ip", F.lit("any")).alias("agent_ip"),
    ).drop("_url", *["_a_" + part for part in urls.PARTS])


def match_nav_rule(df: DataFrame) -> DataFrame:
    return df.filter(
        (F.col("schema_version") == fv.SCHEMA_VERSION)
        & (F.col("event_type") == fv.EVENT_TYPE)
        & (F.col("source") == fv.EVENT_SOURCE)
        & (F.col("browser") == fv.BROWSER)
        & F.col("url").rlike("^https?://")
    )


def extract_url_from_command(df: DataFrame, command: str, out: str = "url") -> DataFrame:
    """First http(s) URL of a command line; lines without one give no row."""
    return df.withColumn(out, F.regexp_extract(command, r"(https?://[^\s]+)", 1)).filter(F.col(out) != "")


def dedup_key(document: Column | None = None) -> Column:
    document = F.col("document_id") if document is None else document
    return F.concat_ws(":", F.col("tab_id").cast("string"), "navigation_kind", F.coalesce(document, F.col("url")))


def dedup_anchored(df: DataFrame, time_ms: str, seq: str, window_ms: int = 2000,
                   key: Column | None = None) -> DataFrame:
    """Add `kept`: false within `window_ms` (inclusive) of the last kept event of the key."""
    keyed = df.withColumn("_dedup_key", dedup_key() if key is None else key)
    return anchored_windows(
        keyed, ["_dedup_key"], time_ms, seq, F.col(time_ms) + F.lit(window_ms), "kept"
    ).drop("_dedup_key")
