"""Verdict cache, quota, circuit breaker and usage rules over an ordered lookup log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from urlvane import fixed_values as fv
from urlvane.functions import times
from urlvane.functions.scratch import discard, written
from urlvane.operators.ordered import anchored_windows, consecutive_count, first_n, in_ranges, last_before
from urlvane.settings import Settings


def lookup_ttl(settings: Settings, provider: Column, malicious: Column, in_database: Column,
               expire_at: Column, ts: Column) -> Column:
    """Seconds a verdict stays cached: match expiry, else positive or negative TTL."""
    listed = F.when(in_database, settings.positive_ttl_s).otherwise(settings.negative_ttl_s)
    return F.when(
        (provider == fv.WEB_RISK) & malicious,
        F.greatest(F.lit(1), F.coalesce(expire_at, ts + 1) - ts),
    ).otherwise(listed)


def cache_replay(log: DataFrame, keys: list[str], ts: str, seq: str, ttl: str, error: Column) -> DataFrame:
    """Add `cache_hit`: a miss opens a TTL window, hits never extend it, errors store nothing."""
    stores = ~error & (F.col(ttl) > 0)
    until = F.when(stores, F.col(ts) + F.col(ttl) - 1).otherwise(F.col(ts) - 1)
    flagged = anchored_windows(log, keys, ts, seq, until, "_miss")
    return flagged.withColumn("cache_hit", ~F.col("_miss")).drop("_miss")


def verdict_cache_asof(asks: DataFrame, puts: DataFrame, keys: list[str], ts: str, seq: str,
                       payload: list[str]) -> DataFrame:
    """Latest put strictly before each ask, used only while it has not expired.

    `puts` carries `expires_at` and the payload columns; `seq` orders equal times.
    """
    value = F.struct("expires_at", *payload)
    stored = puts.select(*keys, ts, seq, value.alias("_put"), F.lit(True).alias("_is_put"))
    merged = asks.withColumn("_is_put", F.lit(False)).unionByName(stored, allowMissingColumns=True)
    merged = merged.withColumn("_order", F.struct(seq, "_is_put"))  # an ask comes before its own put
    seen = last_before(merged, keys, ts, "_order", F.when(F.col("_is_put"), F.col("_put")), "_found")
    alive = F.col("_found.expires_at") > F.col(ts)
    return (
        seen.filter(~F.col("_is_put"))
        .withColumns({
            "cache_hit": F.coalesce(alive, F.lit(False)),
            **{name: F.when(alive, F.col(f"_found.{name}")) for name in payload},
        }).drop("_put", "_is_put", "_order", "_found")
    )


def quota_guard(calls: DataFrame, limit: int, ts: str = "ts", seq: str = "seq",
                provider: str = "provider", used: DataFrame | None = None) -> DataFrame:
    """Add `allowed`: the first `limit` calls per provider and UTC month.

    `used` (provider, month, used) counts calls made before these. Counts per hour and second give the first
    refused call of each provider and month; no provider's calls meet in one task.
    """
    calls = calls.withColumn("month", times.utc_month(ts))
    left = F.lit(limit)
    if used is not None:
        calls = calls.join(used, [provider, "month"], "left")
        left = F.lit(limit) - F.coalesce("used", F.lit(0))
    return first_n(calls, [provider, "month"], ts, seq, left, "allowed").drop(*(["used"] if used is not None else []))


def circuit_open(log: DataFrame, cooldown_s: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Add `open`: the provider's latest earlier outcome is an error less than `cooldown_s` old."""
    outcome = F.struct(F.col(ts).alias("at"), (F.col("outcome") == "error").alias("failed"))
    seen = last_before(log, ["provider"], ts, seq, outcome, "_latest")
    is_open = F.col("_latest.failed") & (F.col("_latest.at") + cooldown_s > F.col(ts))
    return seen.withColumn("open", F.coalesce(is_open, F.lit(False))).drop("_latest")


def consecutive_failures(log: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
    failed = F.col("outcome") == "error"
    return consecutive_count(log, ["provider"], ts, seq, failed, ~failed, "failures")


def monthly_usage(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Requests and errors per provider and UTC month over calls that went out.

    Rows need `cache_hit` and `blocked`; hits and blocked calls are not counted, and a
    failed call counts as a request and as an error.
    """
    calls = log.filter(~F.col("cache_hit") & ~F.col("blocked"))
    return calls.groupBy("provider", times.utc_month(ts).alias("month")).agg(
        F.count("*").alias("request_count"), F.count_if(F.col("outcome") == "error").alias("error_count")
    )


def budget_status(usage: DataFrame, limit: int) -> DataFrame:
    used = F.col("request_count") / F.lit(limit)
    return usage.withColumns({
        "used_fraction": F.round(used, 6),
        "remaining": F.greatest(F.lit(limit) - F.col("request_count"), F.lit(0)),
        "budget_state": F.when(used >= 1.0, "stop").when(used >= 0.9, "warning")
        .when(used >= 0.75, "info").otherwise("ok"),
    })


def _fold_guards(limit: int, cooldown_s: int, ts: str, seq: str):
    """Walk sorted ranges, batch by batch, through cache, circuit and quota in turn.

    Kinds of rows given out: row (a decision), and of a range's end circuit (open until), calls (made per month) and
    cache (expiry of each answer put).
    """
    names = ["_kind", "_part", "provider", "_row", "decision", "_key", "month", "_value"]

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.string(), None, pa.string(), pa.string(), pa.string(), pa.int64()]
        here, row_kind = None, None
        until, cache, made, before = 0, {}, {}, {}

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k or row_kind) for c, k in zip(zip(*rows), kinds)], names)

        def ends():
            return [("circuit", *here, None, None, None, None, until),
                    *[("calls", *here, None, None, None, m, n) for m, n in made.items()],
                    *[("cache", *here, None, None, k, None, v) for k, v in cache.items()]]

        for batch in batches:
            out = []
            row_kind = batch.column(seq).type
            columns = ("_part", "provider", ts, seq, "_key", "month", "_fails", "ttl", "_open_in", "_used_in", "_until_in")
            for part, provider, at, row, key, month, fails, ttl, open_in, used_in, until_in in zip(
                    *[batch.column(c).to_pylist() for c in columns]):
                if here != (part, provider):
                    if here:
                        out += ends()
                    here, until, cache, made = (part, provider), open_in or 0, {}, {}
                if cache.get(key, until_in or 0) > at:
                    decision = "cache_hit"
                elif until > at:
                    decision = "circuit_open"
                elif made.get(month, 0) + (used_in or 0) >= limit:
                    decision = "quota_guard"
                else:
                    made[month] = made.get(month, 0) + 1
                    decision = "error" if fails else "called"
                    if fails:
                        until = at + cooldown_s
                    elif (ttl or 0) > 0:
                        cache[key] = at + ttl
                out.append(("row", part, provider, row, decision, None, None, None))
            if out:
                yield batch_of(out)
        if here:
            yield batch_of(ends())

    return run


def guarded_lookup(log: DataFrame, limit: int, cooldown_s: int, guarded: list[str], ts: str = "ts", seq: str = "seq",
                   used: DataFrame | None = None) -> DataFrame:
    """Add `decision`: cache_hit, circuit_open, quota_guard, error or called, as the guards act one after the other.

    Rows: provider, url (or its key), ts in seconds, unique seq, outcome (of the call if it is made) and ttl. A live cached
    answer is used first. Else, for the `guarded` providers, an open circuit blocks the call, then a used-up month does;
    a call counts against the month also if it fails. A failed call opens the circuit for `cooldown_s`, one that
    succeeds is cached for its ttl. A blocked call fills no cache, opens no circuit and costs no quota. `used` (provider, month,
    used) counts earlier calls. Other providers have a cache only. A null url is a key, a null ttl caches nothing.

    A hot provider's rows are sorted into ranges by row count. What a range does depends on the state it is entered with:
    the end of the open circuit, the calls of the month, and the expiry of its URLs' answers. All ranges are
    walked at once from the states the round before left behind, and again until the states stay the same. A range whose
    entry is right has a right exit, so the right ranges grow by one at least with each round; in practice a state
    is forgotten within a range, and a few rounds do.
    """
    error = F.coalesce(F.col("outcome") == "error", F.lit(False))
    is_guarded = F.coalesce(F.col("provider").isin(guarded), F.lit(False))
    log = written(log, "lookups")
    slim = log.filter(is_guarded).select(
        "provider", ts, seq, F.coalesce("url", F.lit("\0")).alias("_key"), times.utc_month(ts).alias("month"), error.alias("_fails"), "ttl")
    rows = in_ranges(slim, ["provider"], [ts, seq], "guarded")
    keys = written(rows.select("_part", "provider", "_key", F.lit(None).cast("long").alias("_value")).distinct(), "guarded-keys")
    months = rows.groupBy("_part", "provider", "month").agg(F.lit(0).cast("long").alias("_value"))
    if used is None:
        used = log.sparkSession.createDataFrame([], "provider string, month string, used long")
    kind = log.schema[seq].dataType.simpleString()
    before = lambda *by: Window.partitionBy("provider", *by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    state, ends = None, None
    while True:
        entered = rows.withColumns({"_open_in": F.lit(0), "_used_in": F.lit(0), "_until_in": F.lit(0)}).withColumns(
            {c: F.col(c).cast("long") for c in ("_open_in", "_used_in", "_until_in")})
        if ends is not None:
            end = lambda name: ends.filter(F.col("_kind") == name)
            circuit = end("circuit").select("_part", "provider", F.last("_value").over(before()).alias("_open_in"))
            calls = end("calls").select("_part", "provider", "month", "_value").unionByName(months)
            calls = calls.groupBy("_part", "provider", "month").agg(F.sum("_value").alias("_value")).select(
                "_part", "provider", "month", F.coalesce(F.sum("_value").over(before("month")), F.lit(0)).alias("_calls"))
            calls = calls.join(used, ["provider", "month"], "left").select(
                "_part", "provider", "month", (F.col("_calls") + F.coalesce("used", F.lit(0))).alias("_used_in"))
            answers = end("cache").select("_part", "provider", "_key", "_value").unionByName(keys)
            answers = answers.groupBy("_part", "provider", "_key").agg(F.max("_value").alias("_value")).select(
                "_part", "provider", "_key", F.last("_value", ignorenulls=True).over(before("_key")).alias("_until_in"))
            entered = (
                rows.join(circuit, ["_part", "provider"], "left").join(calls, ["_part", "provider", "month"], "left")
                .join(answers.filter("_until_in IS NOT NULL").hint("merge"), ["_part", "provider", "_key"], "left")
            )
        elif used.limit(1).count():
            entered = rows.join(used.withColumnRenamed("used", "_used_in"), ["provider", "month"], "left").withColumns(
                {"_open_in": F.lit(0).cast("long"), "_until_in": F.lit(0).cast("long")})
        walked = written(
            entered.repartition("_part").sortWithinPartitions("_part", "provider", ts, seq).mapInArrow(
                _fold_guards(limit, cooldown_s, ts, seq),
                f"_kind string, _part int, provider string, _row {kind}, decision string, _key string, month string, _value long"), "walked")
        if ends is not None:
            discard(ends)
        ends = walked
        mark = walked.filter("_kind <> 'row'").agg(
            F.count("*"), F.sum(F.xxhash64("_kind", "_part", "provider", "_key", "month", "_value").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
    discard(rows, keys)
    found = walked.filter("_kind = 'row'").select(F.col("_row").alias(seq), "decision")
    plain = cache_replay(log.filter(~is_guarded), ["provider", "url"], ts, seq, "ttl", error)
    plain = plain.withColumn("decision", F.when(F.col("cache_hit"), "cache_hit").when(error, "error").otherwise("called")).drop("cache_hit")
    # decisions are as many as lookups, but their files so small that Spark would broadcast them
    return plain.unionByName(log.filter(is_guarded).join(found.hint("merge"), seq))
