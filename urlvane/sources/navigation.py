"""Navigation logs and alerts as batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from urlvane import schemas
from urlvane.functions.columns import STRICT_JSON, is_one_object
from urlvane.sources.log_tail import tail_lines


def nav_stream(spark: SparkSession, path: str) -> DataFrame:
    """Decodable events of appended JSONL logs as a stream; an incomplete last line waits until it is whole."""
    return tolerant_lines(tail_lines(spark, path))


def tolerant_jsonl(spark: SparkSession, path: str, schema=schemas.NAVIGATION) -> DataFrame:
    """Decodable lines only; partial and malformed lines are skipped."""
    lines = spark.read.text(path)
    return tolerant_lines(lines, "value", schema)


def tolerant_lines(lines: DataFrame, value: str = "value", schema=schemas.NAVIGATION) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **STRICT_JSON}
    parsed = lines.withColumn("_row", F.from_json(F.col(value), schemas.with_corrupt(schema), options))
    usable = F.col("_row").isNotNull() & F.col("_row._corrupt").isNull() & is_one_object(value)
    return parsed.filter(usable).select("_row.*").drop("_corrupt")


def parse_alert(lines: DataFrame, value: str = "value") -> DataFrame:
    """Decode nested alerts; a line that is no JSON object gets `alert_error`."""
    whole = is_one_object(value)
    df = lines.withColumn("alert", F.when(whole, F.from_json(F.col(value), schemas.ALERT, STRICT_JSON)))
    df = df.withColumn("alert_error", F.when(~whole, "alert root is not an object"))
    return df.select(*[c for c in lines.columns], "alert.*", "alert_error")
