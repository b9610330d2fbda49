"""Time text and epoch helpers. `now` is always a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
RFC3339_NANO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _trim_to_micros(text: Column) -> Column:
    return F.regexp_replace(text, r"(\.[0-9]{6})[0-9]+", "$1")


def utc_text(text: Column | str) -> Column:
    """RFC3339 text moved to UTC with trailing zeros of the fraction removed; NULL if invalid."""
    text = _col(text)
    ts = F.try_to_timestamp(_trim_to_micros(text))
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    trimmed = F.regexp_replace(F.regexp_replace(base, r"0+$", ""), r"\.$", "")
    return F.when(text.rlike(RFC3339) & ts.isNotNull(), F.concat(trimmed, F.lit("Z")))


def expire_epoch(text: Column | str) -> Column:
    """Strict RFC3339 text to whole epoch seconds; NULL when the text is not of that form."""
    text = _col(text)
    return F.when(
        text.rlike(RFC3339_NANO), F.unix_seconds(F.try_to_timestamp(_trim_to_micros(text)))
    )


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since the epoch; the session time zone must be UTC for zone-less columns."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def epoch_ms(ts: Column | str) -> Column:
    return F.unix_millis(_col(ts).cast("timestamp"))


def epoch_s(ts: Column | str) -> Column:
    return F.unix_seconds(_col(ts).cast("timestamp"))


def utc_month(epoch_seconds: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_col(epoch_seconds)), "yyyy-MM")
