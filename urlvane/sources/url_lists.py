"""URL lists from CSV, JSON, JSON lines and plain text.

Every reader adds `pos`, a struct that sorts rows in file order: file, offset of the
split in it, and the row's place within the split.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from urlvane import fixed_values as fv

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl"}


def detect_format(path: str, requested: str = "auto") -> str:
    if requested != "auto":
        return requested
    return FORMATS.get(PurePosixPath(path).suffix.lower(), "text")


def _with_position(df: DataFrame) -> DataFrame:
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select("*", place.alias("pos"))


def read_urls_csv(spark: SparkSession, path: str, url: str = "url") -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", False).option("escape", '"').csv(path)
    df = _with_position(df)
    first = df.columns[0]
    df = df.withColumnRenamed(first, first.lstrip("﻿"))
    if url not in df.columns:
        raise ValueError(f"CSV must contain a '{url}' column")
    return df


def read_urls_json(spark: SparkSession, path: str, url: str = "url") -> DataFrame:
    """An array of objects, or an object holding one under a known key (first that is a list)."""
    df = _with_position(spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path))
    for key in fv.LIST_KEYS:
        field = df.schema[key] if key in df.columns else None
        if field is not None and isinstance(field.dataType, T.ArrayType):
            if not isinstance(field.dataType.elementType, T.StructType):
                raise ValueError("JSON input must be an array of objects")
            df = df.select("pos", F.posexplode(key).alias("row", "item"))
            place = F.struct("pos.file", "pos.start", F.col("row").cast("long").alias("row"))
            return df.select("item.*", place.alias("pos"))
    return df


def read_urls_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; blank lines are skipped, a bad line fails the job."""
    return _with_position(spark.read.option("mode", "FAILFAST").json(path))


def url_lines(lines: DataFrame, value: str = "value", url: str = "url") -> DataFrame:
    """Trimmed, non-empty lines that are not `#` comments."""
    text = F.trim(F.regexp_replace(value, r"[\t\r\n\x0B\f]", " "))
    return lines.withColumn(url, text).filter((F.col(url) != "") & ~F.startswith(F.col(url), F.lit("#")))


def read_urls_text(spark: SparkSession, path: str, url: str = "url") -> DataFrame:
    return url_lines(_with_position(spark.read.text(path)), "value", url).drop("value")


def read_urls(spark: SparkSession, path: str, requested: str = "auto", url: str = "url") -> tuple[DataFrame, bool]:
    """The list and whether it is structured (has named fields)."""
    kind = detect_format(path, requested)
    if kind == "csv":
        return read_urls_csv(spark, path, url), True
    if kind == "json":
        return read_urls_json(spark, path, url), True
    if kind == "jsonl":
        return read_urls_jsonl(spark, path), True
    return read_urls_text(spark, path, url), False


def read_labeled_csv(spark: SparkSession, path: str, url: str = "url", label: str = "label") -> DataFrame:
    df = read_urls_csv(spark, path, url)
    if label not in df.columns:
        raise ValueError(f"CSV must contain a '{label}' column")
    return df.select(F.col(url).alias("url"), F.col(label).try_cast("int").alias("label"), "pos")


def read_benign_csv(spark: SparkSession, path: str) -> DataFrame:
    """A one-column list; its header names the column, which becomes `URLs`."""
    return spark.read.option("header", True).csv(path).toDF("URLs")
