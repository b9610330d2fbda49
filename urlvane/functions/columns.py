"""Plan-shape helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like `withColumns`, for long expressions that later filters refer to.

    A filter above a projection is rewritten over the projected expressions and copies
    them once per reference. A one-element `inline` is a step that filters stay above,
    so each expression is evaluated once per row.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select(*kept, F.inline(made))


#: JSON as the standard has it.
STRICT_JSON = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "allowNonNumericNumbers": "false"}


def is_one_object(text: Column | str) -> Column:
    """Whether a text is one JSON object and nothing else: no second value, no trailing text, no single quotes.

    Put in brackets, such a text is a list of one element; anything behind the object breaks the list or adds to it.
    """
    value = F.col(text) if isinstance(text, str) else text
    listed = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>", STRICT_JSON)
    return F.coalesce(F.ltrim(value, F.lit(" \t\r\n")).startswith("{") & (F.size(listed) == 1), F.lit(False))


def per_distinct(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add columns that depend on `key` alone, computed once per distinct value.

    Values are combined map-side, so a hot value costs one row per task. The join back
    is left to Spark: broadcast when the result is small, else by shuffle, where AQE
    splits hot values. For costly columns over rows that repeat their keys.
    """
    return df.join(compute(df.select(key).distinct()), key, "left")


def one_per_key(df: DataFrame, key: str, prefer: list[str]) -> DataFrame:
    """One row per key, so that a join with it repeats no row: the largest by the `prefer` columns in order, then by the others.

    Combined map-side; the join on the same key that follows needs no further shuffle of these rows.
    """
    others = [c for c in df.columns if c != key and c not in prefer]
    best = df.groupBy(key).agg(F.max(F.struct(*prefer, *others)).alias("_best"))
    return best.select(key, "_best.*").select(*df.columns)
