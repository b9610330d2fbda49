"""Writers: event log, envelopes, result lines, feature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from urlvane import fixed_values as fv, schemas


def nav_json(df: DataFrame) -> DataFrame:
    """One JSON text per event in the contract's field order; an absent document id is left out."""
    names = schemas.NAVIGATION.fieldNames()
    return df.select(F.to_json(F.struct(*names)).alias("value"))


def write_nav_jsonl(df: DataFrame, path: str) -> None:
    nav_json(df).write.mode("append").text(path)


def stream_nav_jsonl(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        nav_json(df).writeStream.format("text").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def route_envelope(payload: Column, agent_id: Column, agent_name: Column, agent_ip: Column) -> Column:
    """Queue message: location prefix and compact JSON (non-ASCII text is kept as it is)."""
    agentless = agent_id.isNull() | (agent_id == "000")
    location = F.concat(F.lit("["), agent_id, F.lit("] ("), agent_name, F.lit(") "),
                        F.coalesce(agent_ip, F.lit("any")), F.lit("->"))
    return F.concat(F.lit("1:"), F.when(agentless, "").otherwise(location), F.lit(fv.INTEGRATION + ":"), payload)


def sorted_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with keys in alphabetical order and nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_results_jsonl(df: DataFrame, path: str) -> None:
    sorted_json(df).write.mode("overwrite").text(path)


def write_feature_csv(dataset: DataFrame, folder: str) -> None:
    """legitimate, phishing and urldata as CSV folders with a header."""
    write = lambda df, name: df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    write(dataset.filter(F.col("Label") == 0), "legitimate")
    write(dataset.filter(F.col("Label") == 1), "phishing")
    write(dataset, "urldata")
