"""One frozen set of parameters with its legal ranges."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from urlvane import fixed_values as fv


@dataclass(frozen=True)
class Settings:
    """Defaults; `check()` raises ValueError on the first value out of range."""

    provider: str = fv.PHISHTANK
    threat_types: tuple[str, ...] = ("SOCIAL_ENGINEERING",)
    positive_ttl_s: int = 21600
    negative_ttl_s: int = 900
    monthly_limit: int = 90000
    circuit_s: int = 300
    retry_count: int = 1
    max_response_bytes: int = fv.WEB_RISK_MAX_BYTES
    ml_enabled: bool = False
    ml_mode: str = "modern"
    threshold: float | None = None
    review_threshold: float = fv.REVIEW_THRESHOLD
    legacy_network_features: bool = True
    navigation_rule_id: str = fv.NAVIGATION_RULE_ID

    def __post_init__(self) -> None:
        object.__setattr__(self, "provider", str(self.provider).replace("-", "_"))
        wanted = []
        for value in self.threat_types:
            name = str(value).strip().upper()
            if name not in fv.THREAT_TYPES:
                raise ValueError(f"unknown threat type {name}")
            if name not in wanted:
                wanted.append(name)
        object.__setattr__(self, "threat_types", tuple(wanted))
        self.check()

    def check(self) -> None:
        ranges = {
            "negative_ttl_s": (0, 86400),
            "monthly_limit": (1, 10_000_000),
            "circuit_s": (1, 3600),
            "retry_count": (0, 3),
            "max_response_bytes": (1024, 1024 * 1024),
            "review_threshold": (0.0, 1.0),
        }
        for name, (low, high) in ranges.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")
        if self.provider not in fv.PROVIDERS:
            raise ValueError("provider must be one of " + ", ".join(fv.PROVIDERS))
        if not self.threat_types:
            raise ValueError("threat_types must not be empty")
        for name in ("ml_enabled", "legacy_network_features"):
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} must be true or false")
        if self.ml_mode not in ("modern", "legacy_svr"):
            raise ValueError("ml_mode must be modern or legacy_svr")
        if self.threshold is not None:
            if not 0.0 <= self.threshold <= 1.0:
                raise ValueError("threshold must be between 0 and 1")
            if self.review_threshold >= self.threshold:
                raise ValueError("review_threshold must be lower than threshold")
        rule = str(self.navigation_rule_id)
        if not rule.isdigit() or not 100000 <= int(rule) <= 120000:
            raise ValueError("navigation_rule_id must be between 100000 and 120000")

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> Settings:
        """Build from a flat mapping; unknown names are an error."""
        known = {field.name for field in fields(cls)}
        extra = set(values) - known
        if extra:
            raise ValueError("unknown settings: " + ", ".join(sorted(extra)))
        return cls(**dict(values))
