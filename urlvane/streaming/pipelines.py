"""Structured Streaming forms of the operators.

State is keyed, expires in event time and never holds rows, only the last anchor or
expiry. Sinks are idempotent per batch: a repeated batch overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from urlvane.operators import guards, navigation


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    return (
        df.writeStream.format(fmt).outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_batches(df: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(function).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# --- Validation ------------------------------------------------------------

def stream_validate(events: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Accepted events to one folder, rejections to another; bad rows stop nothing."""
    validated = navigation.validate_nav_event(events)

    def both(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        fine, refused = navigation.split_valid_quarantine(batch)
        fine.write.mode("overwrite").parquet(f"{accepted_path}/batch={batch_id}")
        refused.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        batch.unpersist()

    return write_batches(validated, both, checkpoint)


# --- Keyed windows ---------------------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AnchoredWindows(StatefulProcessor):
    """Per key the end of the last window opened, in a value state that an event-time timer clears.

    Rows of a key are taken in (time, seq) order within a micro-batch. A row is late if it is older than the largest event time seen
    less `lateness_ms`; late rows come out flagged and change nothing. Spark's own watermark lies `grace_ms` behind
    that, so rows are lost only if they are later than both together. `per_second` is the unit of the time column.
    """

    def __init__(self, time: str, seq: str, columns: list[str], out: str, per_second: int, grace_ms: int):
        self.time, self.seq, self.columns, self.out = time, seq, columns, out
        self.unit, self.grace = per_second, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cover = handle.getValueState("cover", T.StructType([T.StructField("until", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        known = timerValues.getCurrentWatermarkInMs()
        late_before = (known + self.grace) * self.unit // 1000 if known > 0 else _NEVER
        frames = pd.concat(list(rows), ignore_index=True)
        frames.columns = [*self.columns, "_until"]  # Spark hands the columns over in order, not always by name
        frames = frames.sort_values([self.time, self.seq], kind="stable")
        cover = self.cover.get()[0] if self.cover.exists() else _NEVER
        opened, late = [], []
        for at, until in zip(frames[self.time].tolist(), frames["_until"].tolist()):
            late.append(at < late_before)
            opened.append(not late[-1] and at > cover)
            if opened[-1] and until >= at:
                cover = int(until)
        if any(opened):
            self._keep(cover, known)
        frames[self.out], frames["late"] = opened, late
        yield frames[[*self.columns, self.out, "late"]]

    def _keep(self, cover: int, known: int) -> None:
        """Remember the cover until no row can be in it and not be late; one timer per key."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(timer[0] if isinstance(timer, tuple) else timer))
        end = (cover + 1) * 1000 // self.unit - self.grace
        if end > known:
            self.cover.update((cover,))
            self.handle.registerTimer(int(end))
        else:
            self.cover.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.cover.clear()
        return iter([])

    def close(self) -> None:
        pass


_NEVER = -(2**62)


def _milliseconds(spark: SparkSession, text: str) -> int:
    return spark.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {text}")) / 1000).cast("long")).first()[0]


def keyed_windows(df: DataFrame, keys: list[str], event_time: str, time: str, seq: str,
                  cover_until: Column, out: str, per_second: int, lateness: str, grace: str = "1 day") -> DataFrame:
    """Flag rows that open a window (`out`) and rows that came too late to be judged (`late`).

    The state of a key is one number, dropped by a timer once no row within `lateness` can fall into its window. The
    rows of one key in one micro-batch are sorted in one task: bound the batch with `maxFilesPerTrigger`.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # this operator's state needs it
    columns = df.columns
    grace_ms = _milliseconds(spark, grace)
    delay = f"{_milliseconds(spark, lateness) + grace_ms} milliseconds"
    rows = df.withColumn("_until", cover_until.cast("long")).withWatermark(event_time, delay)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType()), T.StructField("late", T.BooleanType())])
    return rows.groupBy(*keys).transformWithStateInPandas(
        AnchoredWindows(time, seq, columns, out, per_second, grace_ms), schema, "append", "eventTime")


def stream_dedup(events: DataFrame, event_time: str, time_ms: str, seq: str, key: Column | None = None,
                 window_ms: int = 2000, lateness: str = "10 seconds", with_late: bool = False) -> DataFrame:
    """Events that are not within `window_ms` of the last kept event of their key.

    with_late adds the events that came too late to be judged, with `late` true.
    """
    keyed = events.withColumn("_key", navigation.dedup_key() if key is None else key)
    flagged = keyed_windows(
        keyed, ["_key"], event_time, time_ms, seq, F.col(time_ms) + window_ms, "kept", 1000, lateness
    )
    if with_late:
        return flagged.filter("kept OR late").drop("_key", "kept")
    return flagged.filter("kept").drop("_key", "kept", "late")


def stream_cache(log: DataFrame, event_time: str, ts: str, seq: str, ttl: str, error: Column,
                 lateness: str = "10 minutes") -> DataFrame:
    """Add `cache_hit` per (provider, url) with a time-to-live in event time; a late row is no hit and has `late` true."""
    stores = ~error & (F.col(ttl) > 0)
    until = F.when(stores, F.col(ts) + F.col(ttl) - 1).otherwise(F.col(ts) - 1)
    flagged = keyed_windows(log, ["provider", "url"], event_time, ts, seq, until, "_miss", 1, lateness)
    return flagged.withColumn("cache_hit", ~F.col("_miss") & ~F.col("late")).drop("_miss")


# --- Guards ----------------------------------------------------------------

def _latest(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """The guard totals written by the last batch before this one."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.parquet(path).filter(F.col("batch") < batch_id)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    newest = stored.agg(F.max("batch")).scalar()
    return stored.filter(F.col("batch") == newest).drop("batch")


def stream_guards(log: DataFrame, limit: int, cooldown_s: int, out_path: str, state_path: str, checkpoint: str) -> StreamingQuery:
    """Quota and circuit per provider, batch by batch.

    Totals per provider and month, and the last outcome per provider, are small tables
    written once per batch; a repeated batch reads the totals from before itself.
    """

    def guard(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        used = _latest(spark, f"{state_path}/used", batch_id, "provider string, month string, used long")
        last = _latest(spark, f"{state_path}/last", batch_id, "provider string, ts long, seq long, outcome string")
        seeded = batch.withColumn("_seed", F.lit(False)).unionByName(
            last.withColumn("_seed", F.lit(True)), allowMissingColumns=True
        )
        opened = guards.circuit_open(seeded, cooldown_s).filter(~F.col("_seed")).drop("_seed")
        flagged = guards.quota_guard(opened, limit, used=used).persist()
        flagged.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        made = flagged.filter("allowed").groupBy("provider", "month").agg(F.count("*").alias("used"))
        total = used.unionByName(made).groupBy("provider", "month").agg(F.sum("used").alias("used"))
        newest = F.max_by(F.struct("ts", "seq", "outcome"), F.struct("ts", "seq")).alias("_row")
        ends = last.unionByName(batch.select("provider", "ts", "seq", "outcome"))
        ends = ends.groupBy("provider").agg(newest).select("provider", "_row.*")
        total.coalesce(1).write.mode("overwrite").parquet(f"{state_path}/used/batch={batch_id}")
        ends.coalesce(1).write.mode("overwrite").parquet(f"{state_path}/last/batch={batch_id}")
        flagged.unpersist()
        batch.unpersist()

    return write_batches(log, guard, checkpoint)


# --- Correlation and windows -----------------------------------------------

def stream_correlate(navigations: DataFrame, classifications: DataFrame, wait_s: int = 600) -> DataFrame:
    """Left outer join on the event id; an event waits at most `wait_s` for its result.

    Inputs: (event_id, nav_time, …) and (source_event_id, result_time, …).
    """
    left = navigations.withWatermark("nav_time", "1 minute")
    right = classifications.withWatermark("result_time", "1 minute")
    near = F.col("result_time").between(F.col("nav_time"), F.col("nav_time") + F.expr(f"INTERVAL {wait_s} SECONDS"))
    return left.join(right, (F.col("event_id") == F.col("source_event_id")) & near, "leftOuter")


def stream_repeat_windows(events: DataFrame, ts: str = "ts", url: str = "url", minutes: int = 5,
                          lateness: str = "10 minutes") -> DataFrame:
    """Visits per URL and tumbling window; closed windows leave the state."""
    timed = events.withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", lateness)
    return timed.groupBy(F.window("_time", f"{minutes} minutes").alias("w"), url).agg(
        F.count("*").alias("visits")
    ).select(F.unix_seconds("w.start").alias("window_start_s"), url, "visits")
