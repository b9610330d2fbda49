"""Provider verdicts: decoding, normalizing, joining, and destination checks."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from urlvane import fixed_values as fv, schemas
from urlvane.functions.columns import STRICT_JSON, is_one_object, one_per_key
from urlvane.functions import times
from urlvane.functions.urls import IPV4, IPV6


def truthy(value: Column | str) -> Column:
    """True for the accepted words in any case; the column is text (JSON true is `true`)."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.lower(value).isin(fv.TRUE_WORDS), F.lit(False))


def phishtank_columns(df: DataFrame) -> DataFrame:
    """From text columns in_database, verified and valid to status and malicious."""
    df = df.withColumns({name: truthy(name) for name in ("in_database", "verified", "valid")})
    confirmed = F.col("in_database") & F.col("verified") & F.col("valid")
    return df.withColumns({
        "rep_malicious": confirmed,
        "rep_status": F.when(confirmed, "malicious")
        .when(F.col("in_database"), "listed_inactive").otherwise("not_found"),
    })


def reputation_phishtank(events: DataFrame, feed: DataFrame, url: str = "url") -> DataFrame:
    """Exact-URL lookup; a URL absent from the feed is `not_found`. Of repeated feed rows a confirmed one counts first.

    Spark picks the join: a feed below the broadcast threshold is broadcast, a larger
    one is shuffled on the URL and AQE splits hot URLs.
    """
    verdicts = phishtank_columns(feed).select(
        F.col("url").alias(url), "rep_status", "rep_malicious", "in_database", "verified", "valid",
        F.col("phish_id").cast("string").alias("phish_id"), F.col("phish_detail_page").alias("detail_url"),
    )
    verdicts = one_per_key(verdicts, url, ["rep_malicious", "in_database", "verified", "valid"])
    joined = events.join(verdicts, url, "left")
    return joined.withColumns({
        "rep_status": F.coalesce("rep_status", F.lit("not_found")),
        **{n: F.coalesce(n, F.lit(False)) for n in ("rep_malicious", "in_database", "verified", "valid")},
        "rep_error": F.lit(None).cast("string"),
    })


def webrisk_columns(df: DataFrame, now_s: Column, wanted: tuple[str, ...]) -> DataFrame:
    """From threat_types_raw (array) and expire_time to status, types, expiry and error.

    `threat_present` false means an empty answer, which is `not_found`.
    """
    raw = F.transform("threat_types_raw", lambda x: F.upper(F.trim(x)))
    df = df.withColumns({"_types": raw, "expire_at": times.expire_epoch("expire_time")})
    allowed = [name for name in fv.THREAT_TYPES if name in wanted]
    problem = (
        F.when(F.col("_types").isNull() | (F.size("_types") == 0), "Google Web Risk threat has no threatTypes")
        .when(~F.forall("_types", lambda x: F.coalesce(x.isin(allowed), F.lit(False))),
              "Google Web Risk returned an unexpected threat type")
        .when(F.col("expire_time").isNull() | (F.col("expire_time") == ""), "Google Web Risk match has no expireTime")
        .when(F.col("expire_at").isNull(), "Google Web Risk match has an invalid expireTime")
        .when(F.col("expire_at") <= now_s, "Google Web Risk match expireTime is not in the future")
    )
    present = F.coalesce(F.col("threat_present"), F.lit(False))
    df = df.withColumn("rep_error", F.when(present, problem))
    good = present & F.col("rep_error").isNull()
    return df.withColumns({
        "rep_status": F.when(good, "malicious").when(F.col("rep_error").isNull(), "not_found"),
        "rep_malicious": good,
        "in_database": good, "verified": good, "valid": good,
        "threat_types": F.when(good, F.array_distinct("_types")).otherwise(F.array().cast("array<string>")),
        "expire_at": F.when(good, F.col("expire_at")),
    }).drop("_types")


def reputation_webrisk(events: DataFrame, feed: DataFrame, now_s: Column,
                       wanted: tuple[str, ...] = ("SOCIAL_ENGINEERING",), url: str = "url") -> DataFrame:
    """Exact-URL lookup of stored answers; of repeated ones the latest expiry text counts."""
    answers = feed.select(F.col("url").alias(url), "threat_types_raw", "expire_time", F.lit(True).alias("threat_present"))
    answers = one_per_key(answers, url, ["expire_time"])
    return webrisk_columns(events.join(answers, url, "left"), now_s, wanted).drop("threat_types_raw", "threat_present")


def parse_provider_response(df: DataFrame, provider: str, body: str = "body",
                            max_bytes: int | None = None) -> DataFrame:
    """Decode stored response bodies; `response_error` tells why a body is unusable."""
    phish = provider == fv.PHISHTANK
    name = "PhishTank" if phish else "Google Web Risk"
    limit = max_bytes or (fv.PHISHTANK_MAX_BYTES if phish else fv.WEB_RISK_MAX_BYTES)
    schema = schemas.PHISHTANK_RESPONSE if phish else schemas.WEB_RISK_RESPONSE
    text = F.trim(F.col(body))
    # A bare JSON value wrapped in an array parses exactly when the value itself does.
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", {"mode": "PERMISSIVE", **STRICT_JSON})
    root = F.when(F.size(wrapped) == 1, F.try_element_at(wrapped, F.lit(1)))
    df = df.withColumn("_object", F.when(is_one_object(text), F.from_json(text, "map<string,string>", STRICT_JSON)))
    df = df.withColumn(
        "response_error",
        F.when(F.octet_length(body) > limit, f"{name} response exceeded size limit")
        .when(~F.startswith(text, F.lit("{")) & root.isNotNull(), f"{name} response root is not an object")
        .when(F.col("_object").isNull(), f"{name} returned invalid JSON"),
    )
    df = df.withColumn("response", F.when(F.col("response_error").isNull(), F.from_json(text, schema)))
    if phish:
        missing = F.col("response_error").isNull() & F.col("response.results").isNull()
        df = df.withColumn("response_error", F.when(missing, f"{name} response is missing results").otherwise(F.col("response_error")))
    else:
        filled = F.size("_object") > 0
        missing = F.col("response_error").isNull() & filled & F.col("response.threat").isNull()
        df = df.withColumn("response_error", F.when(missing, f"{name} response is missing threat").otherwise(F.col("response_error")))
    return df.drop("_object")


def ip_number(ip: Column) -> Column:
    """A dotted quad as a number; NULL for anything else."""
    octet = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("long")
    return octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)


def ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit groups of an IPv6 text as an array of numbers."""
    sides = F.split(ip, "::")
    numbers = lambda text: F.transform(
        F.filter(F.split(F.coalesce(text, F.lit("")), ":"), lambda x: x != ""),
        lambda x: F.conv(x, 16, 10).try_cast("long"),
    )
    left, right = numbers(F.get(sides, F.lit(0))), numbers(F.get(sides, F.lit(1)))
    gap = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    return F.concat(left, F.array_repeat(F.lit(0).cast("long"), gap), right)


def _inside_v6(groups: Column, block: str) -> Column:
    net = ipaddress.ip_network(block)
    number, bits, tests = int(net.network_address), net.prefixlen, F.lit(True)
    for i in range(8):
        used = min(max(bits - 16 * i, 0), 16)
        if used:
            want = (number >> (112 - 16 * i)) & 0xFFFF
            tests = tests & (F.shiftright(F.get(groups, F.lit(i)), 16 - used) == want >> (16 - used))
    return tests


def with_public_flag(df: DataFrame, ip: str = "ip", out: str = "public") -> DataFrame:
    """Add whether an address lies outside every special-purpose block.

    The block tables are fixed, so they are written into the expression and cost
    neither a join nor a broadcast. Text that is no address is not public.
    """
    mapped = F.regexp_extract(F.lower(ip), rf"^::ffff:({IPV4})$", 1)
    df = df.withColumns({
        "_number": ip_number(F.when(mapped != "", mapped).otherwise(F.col(ip))),
        "_groups": F.when((mapped == "") & F.col(ip).rlike(rf"^{IPV6}$"), ipv6_groups(F.col(ip))),
        "_v4": (mapped != "") | F.col(ip).rlike(rf"^{IPV4}$"),
    })

    def within(block: str) -> Column:
        net = ipaddress.ip_network(block)
        return F.col("_number").between(int(net.network_address), int(net.broadcast_address))

    either = lambda tests: reduce(or_, tests)
    v4 = ~either(map(within, fv.NON_GLOBAL_IPV4)) | either(map(within, fv.GLOBAL_IPV4_EXCEPTIONS))
    v6 = ~either(_inside_v6(F.col("_groups"), b) for b in fv.NON_GLOBAL_IPV6) | either(
        _inside_v6(F.col("_groups"), b) for b in fv.GLOBAL_IPV6_EXCEPTIONS
    )
    public = F.when(F.col("_v4"), v4).when(F.col("_groups").isNotNull(), v6)
    return df.withColumn(out, F.coalesce(public, F.lit(False))).drop("_number", "_groups", "_v4")


def filter_public_destination(df: DataFrame, resolution: DataFrame, host: str = "url_host") -> DataFrame:
    """Keep rows whose host resolves to public addresses only (at least one address)."""
    verdict = with_public_flag(resolution).groupBy(F.col("host").alias(host)).agg(
        F.bool_and("public").alias("_public")
    ).filter("_public").select(host)
    return df.join(verdict, host, "left_semi")
