"""Severity policy: verdict to role, level, groups, technique and host-only text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from urlvane import fixed_values as fv
from urlvane.functions.columns import settle


def alert_role(status: Column, source: Column, provider: str) -> Column:
    return (
        F.when((status == "malicious") & (source == provider), "reputation")
        .when((status == "suspicious") & (source == "ml"), "ml")
        .when((status == "review") & (source == "ml"), "review")
        .when(status == "error", "error")
        .when(status.isin(fv.NEGATIVE_STATUSES), "negative")
        .otherwise("base")
    )


def _render(template: str, fields: dict[str, Column]) -> Column:
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [F.lit(x) if i % 2 == 0 else F.coalesce(fields[x].cast("string"), F.lit("")) for i, x in enumerate(pieces)]
    return F.concat(*parts)


def alert_policy(provider: str, staging: bool = False, levels: dict[str, int] | None = None,
                 first_rule: int = int(fv.NAVIGATION_RULE_ID)) -> dict[str, dict]:
    """Role to rule id, level, groups and technique; a few fixed entries."""
    merged = {**fv.ALERT_LEVELS, **(levels or {})}
    if staging and not (levels and "negative" in levels):
        merged["negative"] = fv.STAGING_NEGATIVE_LEVEL
    for role, level in merged.items():
        if not 0 <= level <= 16:
            raise ValueError(f"level of {role} must be between 0 and 16")
    policy = {}
    for role, offset in fv.ALERT_RULE_OFFSETS.items():
        groups = fv.ALERT_GROUPS[provider if role == "reputation" else role]
        technique = fv.TECHNIQUE if role in ("reputation", "ml", "review") else None
        policy[role] = {"rule_id": str(first_rule + offset), "level": merged[role],
                        "groups": groups, "technique": technique}
    return policy


def assign_alerts(df: DataFrame, provider: str, staging: bool = False,
                  levels: dict[str, int] | None = None) -> DataFrame:
    """Add role, rule_id, level, groups, technique and description.

    The policy has six fixed roles, so it is applied as one expression, not as a join.
    """
    policy = alert_policy(provider, staging, levels)
    df = settle(df, {"role": alert_role(F.col("status"), F.col("source"), provider)})

    def pick(value) -> Column:
        chosen = F.when(F.lit(False), F.lit(None))
        for role, entry in policy.items():
            chosen = chosen.when(F.col("role") == role, value(role, entry))
        return chosen

    fields = {name: F.col(name) for name in df.columns}
    if "threat_types" in fields:
        fields["threat_types"] = F.array_join("threat_types", ", ")
    for name in ("threat_types", "score", "model_kind", "calibrated", "review_threshold", "threshold", "error"):
        fields.setdefault(name, F.lit(""))
    texts = {role: fv.ALERT_TEXTS[provider if role == "reputation" else role] for role in policy}
    return df.withColumns({
        "rule_id": pick(lambda role, e: F.lit(e["rule_id"])),
        "level": pick(lambda role, e: F.lit(e["level"])),
        "groups": pick(lambda role, e: F.array(*[F.lit(g) for g in e["groups"]]).cast("array<string>")),
        "technique": pick(lambda role, e: F.lit(e["technique"]).cast("string")),
        "description": pick(lambda role, e: _render(texts[role], fields)),
    })


def emit_alerts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("level") > 0)


def navigation_alerts(matched: DataFrame, level: int = fv.ALERT_LEVELS["navigation"]) -> DataFrame:
    """Alerts of rows that matched the navigation rule; host only, never the URL."""
    text = _render(fv.ALERT_TEXTS["navigation"], {n: F.col(n) for n in ("url_host", "event_id")})
    return matched.select(
        "event_id", "url_host", F.lit(fv.NAVIGATION_RULE_ID).alias("rule_id"), F.lit(level).alias("level"),
        F.lit(fv.TECHNIQUE).alias("technique"), text.alias("description"),
        F.array(*[F.lit(g) for g in fv.ALERT_GROUPS["navigation"]]).alias("groups"),
    )
