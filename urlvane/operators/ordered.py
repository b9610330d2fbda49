"""Order-dependent operators that hold up when one key owns a third of all rows.

A plain window over such a key runs in one task. Here rows are sorted into ranges by key, time and sequence, and
the ranges are cut by row count (Spark samples the rows for that), so a hot key is spread over many ranges however its rows
lie in time. Work inside a range is keyed by (key, range). Between ranges only summaries travel, and only of keys
that go over a border: a value, a pair of numbers, or the step function "cover left behind for each way in".
Summaries combine in any grouping, so a range never needs the rows of another.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from urlvane.functions.scratch import written


def in_ranges(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with `_part`, the number of the range each lies in; ranges ascend by (keys, order)."""
    ranges = df.repartitionByRange(*keys, *order)
    return written(ranges.withColumn("_part", F.spark_partition_id()), name)


def _crossing(rows: DataFrame, keys: list[str], summaries: list[Column]) -> DataFrame:
    """One summary per (key, range) of the keys that lie in several ranges; at most two rows per range."""
    spans = rows.groupBy("_part").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"))
    along = Window.orderBy("_part")
    ends = spans.withColumn("_went", F.lag("high").over(along)).filter(F.col("_went").eqNullSafe(F.col("low")))
    crossing = ends.select(*[F.col(f"low.{k}").alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    test = same[0]
    for one in same[1:]:
        test = test & one
    return rows.join(crossing, test, "left_semi").groupBy(*keys, "_part").agg(*summaries)


def _joined(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on (key, range) that takes null keys as equal."""
    named = carried.withColumnsRenamed({**{k: f"_r_{k}" for k in keys}, "_part": "_r_part"})
    test = F.col("_part") == F.col("_r_part")
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return rows.join(named, test, "left").drop("_r_part", *[f"_r_{k}" for k in keys])


def last_before(df: DataFrame, keys: list[str], time: str, seq: str, value: Column, out: str) -> DataFrame:
    """Add `out`: the latest non-null `value` strictly before the row in (time, seq) order; `seq` is unique per key."""
    rows = in_ranges(df.withColumn("_value", value), keys, [time, seq], "last-before")
    newest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(time, seq))).alias("_last")
    along = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = _crossing(rows, keys, [newest]).select(*keys, "_part", F.last("_last", ignorenulls=True).over(along).alias("_carry"))
    inside = Window.partitionBy("_part", *keys).orderBy(time, seq).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_here", F.last("_value", ignorenulls=True).over(inside))
    return _joined(found, carried, keys).withColumn(out, F.coalesce("_here", "_carry")).drop("_part", "_value", "_here", "_carry")


def consecutive_count(df: DataFrame, keys: list[str], time: str, seq: str, hit: Column, reset: Column, out: str) -> DataFrame:
    """Running number of `hit` rows since the last `reset` row (a reset row counts 0)."""
    inside = Window.partitionBy("_part", *keys).orderBy(time, seq).rowsBetween(Window.unboundedPreceding, 0)
    rows = in_ranges(df.withColumns({
        "_hit": F.coalesce(hit, F.lit(False)).cast("long"), "_reset": F.coalesce(reset, F.lit(False)),
    }), keys, [time, seq], "consecutive")
    counted = rows.withColumn("_run", F.sum("_hit").over(inside))
    counted = counted.withColumn("_base", F.max(F.when(F.col("_reset"), F.col("_run"))).over(inside))
    # of a range: its hits after its last reset, and whether it has one
    tail = F.max("_run") - F.coalesce(F.max("_base"), F.lit(0))
    parts = _crossing(counted, keys, [tail.alias("_sum"), F.max("_base").isNotNull().alias("_any")])
    along = Window.partitionBy(*keys).orderBy("_part")
    parts = parts.withColumn("_island", F.sum(F.col("_any").cast("int")).over(along))
    before = Window.partitionBy(*keys, "_island").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = parts.withColumn("_upto", F.sum("_sum").over(before)).select(*keys, "_part", F.lag("_upto").over(along).alias("_carry"))
    total = F.when(F.col("_base").isNull(), F.col("_run") + F.coalesce("_carry", F.lit(0))).otherwise(F.col("_run") - F.col("_base"))
    return _joined(counted, carried, keys).withColumn(out, total).drop("_part", "_hit", "_reset", "_run", "_base", "_carry")


def first_n(df: DataFrame, keys: list[str], time: str, seq: str, n: Column, out: str) -> DataFrame:
    """Flag the first `n` rows of each group in (time, seq) order; `time` is in whole seconds, n a number per group.

    Counts per hour, combined map-side, give the hour that holds the cut, counts per second in that hour the second; only the
    rows of that second are ranked. `keys` must have few values: one cut per group, joined by Spark's choice.
    """
    def edge(rows: DataFrame, by: Column, left: Column) -> DataFrame:
        counts = rows.withColumns({"_slot": by, "_left": left}).groupBy(*keys, "_slot").agg(
            F.count("*").alias("_n"), F.first("_left").alias("_left"))
        along = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_upto", F.sum("_n").over(along))
        held = counts.filter((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_n") <= F.col("_left")))
        return held.select(*keys, "_slot", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_rest"))

    slim = df.select(*keys, F.col(time).alias("_t"), F.col(seq).alias("_s"), n.alias("_quota"))
    hour = F.floor(F.col("_t") / 3600)
    hours = slim.withColumn("_slot", hour).join(edge(slim, hour, F.greatest("_quota", F.lit(0))), [*keys, "_slot"]).drop("_slot")
    second = F.col("_t")
    seconds = hours.withColumn("_slot", second).join(
        edge(hours, second, F.col("_rest")).withColumnRenamed("_rest", "_more"), [*keys, "_slot"]).drop("_slot")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_s"))
    refused = seconds.withColumn("_rank", rank).filter(F.col("_rank") == F.col("_more") + 1)
    cuts = refused.select(*keys, F.struct("_t", "_s").alias("_cut"))  # the first row beyond the quota
    within = F.col("_cut").isNull() | (F.struct(F.col(time).alias("_t"), F.col(seq).alias("_s")) < F.col("_cut"))
    return df.join(cuts, keys, "left").withColumn(out, within).drop("_cut")


def top_n_per_group(df: DataFrame, keys: list[str], order: list[str], n: int,
                    descending: bool = False, salts: int = 64, rank: str | None = None) -> DataFrame:
    """First `n` rows of each group; a hot group is cut to n rows per salt before it meets.

    `order` must be total (end it with a unique column). It decides the result, the
    salts do not.
    """
    by = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    near = Window.partitionBy(*keys, "_salt").orderBy(*by)
    final = Window.partitionBy(*keys).orderBy(*by)
    top = (
        df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(near)).filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final)).filter(F.col("_rank") <= n)
        .drop("_salt")
    )
    return top.withColumnRenamed("_rank", rank) if rank else top.drop("_rank")


def first_fraction(df: DataFrame, keys: list[str], order: str, fraction: float, out: str) -> DataFrame:
    """Flag the first ceil(fraction * n) rows of each group by a unique hex-text order.

    A histogram over the first four hex digits (at most 65,536 rows per group) finds
    the bucket of the cut; only that bucket is ranked. `keys` must have few values.
    """
    rows = df.withColumn("_bucket", F.substring(order, 1, 4))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({
        "_need": F.ceil(F.sum("_n").over(group) * F.lit(fraction)),
        "_upto": F.sum("_n").over(running),
    }).filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
    edge = counts.select(*keys, "_bucket", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_left"))
    ranked = rows.join(edge, [*keys, "_bucket"]).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    )
    cut = ranked.filter(F.col("_rank") == F.col("_left")).select(*keys, F.col(order).alias("_cut"))
    return (
        df.join(cut, keys, "left")
        .withColumn(out, F.coalesce(F.col(order) <= F.col("_cut"), F.lit(False))).drop("_cut")
    )


def first_rows(df: DataFrame, keys: list[str], position: str, out: str) -> DataFrame:
    """Flag the row with the lowest unique `position` of each key.

    The minimum is combined map-side and joined back on the position, which is
    unique, so a hot key never meets in one task.
    """
    firsts = df.groupBy(*keys).agg(F.min(position).alias(position)).select(position, F.lit(True).alias(out))
    return df.join(firsts, position, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


_NEVER = -(2**62)


def _changes(batch: pa.RecordBatch, keys: list[str], before: tuple | None) -> list[bool]:
    """Per row whether its key differs from the row's before; `before` is the last key of the batch before."""
    changed = [False] * batch.num_rows
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_pylist()
        changed = [c or a != b for c, a, b in zip(changed, codes, codes[:1] + codes)]
    changed[0] = before is None or before != _key(batch, keys, 0)
    return changed


def _key(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _steps(times: list[int], covers: list[int]) -> list[tuple[int, int]]:
    """The cover left behind as a step function: for cover c on entry, the value of the first step above c, else c itself.

    `times` ascend and hold one opening row each. Entries that lead to the same cover are one step.
    """
    from bisect import bisect_right

    left = list(covers)
    for i in range(len(times) - 1, -1, -1):
        following = bisect_right(times, covers[i])
        if following < len(times):
            left[i] = left[following]
    return [(t, c) for i, (t, c) in enumerate(zip(times, left)) if i + 1 == len(times) or left[i + 1] != c]


def _fold_range(keys: list[str], time: str, seq: str):
    """Walk one sorted range of instants, batch by batch.

    Kinds of rows given out: open (an instant that opens), head (an instant of the range's first key, which an
    earlier range may cover), step (of the head's step function; the first is a marker) and exit (the cover that the
    range's last key leaves behind, where that is not the first).
    """
    names = [*keys, "_kind", "_part", time, seq, "_until"]

    def rows(batch, kind, part):
        size = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in keys], pa.array([kind] * size, pa.string()), pa.array([part] * size, pa.int32()),
             batch.column(time), batch.column(seq), batch.column("_until")], names)

    def run(batches):
        part, before, in_head, cover = TaskContext.get().partitionId(), None, True, _NEVER
        first = last = None
        times, covers = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            at, until = batch.column(time).to_pylist(), batch.column("_until").to_pylist()
            opened, headed = [], []
            for i, new in enumerate(_changes(batch, keys, before)):
                if new:
                    if first is None:
                        first = batch.slice(i, 1)
                    else:
                        in_head = False
                    cover = _NEVER
                if in_head:
                    headed.append(i)
                    if until[i] is not None:
                        times.append(at[i])
                        covers.append(until[i])
                elif at[i] > cover:
                    opened.append(i)
                    cover = cover if until[i] is None else until[i]
            before, last = _key(batch, keys, batch.num_rows - 1), batch.slice(batch.num_rows - 1, 1)
            for kind, places in (("open", opened), ("head", headed)):
                if places:
                    yield rows(batch.take(pa.array(places, pa.int64())), kind, part)
        if first is not None:
            steps = [(_NEVER, _NEVER), *_steps(times, covers)]
            ends = [(first, "step", steps)] + ([] if in_head else [(last, "exit", [(_NEVER + 1, cover)])])
            for row, kind, pairs in ends:
                many = row.take(pa.array([0] * len(pairs), pa.int64()))
                many = many.set_column(many.schema.get_field_index(time), time, pa.array([p[0] for p in pairs], pa.int64()))
                many = many.set_column(many.schema.get_field_index("_until"), "_until", pa.array([p[1] for p in pairs], pa.int64()))
                yield rows(many, kind, part)

    return run


def _walk_ranges(keys: list[str], time: str):
    """From the summaries of each key's ranges, in order, the cover on entry into each range that it begins."""
    names = [*keys, "_part", "_cover_in"]

    def run(batches):
        before, cover, following, resolved = None, _NEVER, _NEVER, True
        for batch in batches:
            if not batch.num_rows:
                continue
            entry, until = batch.column(time).to_pylist(), batch.column("_until").to_pylist()
            places, found = [], []
            for i, new in enumerate(_changes(batch, keys, before)):
                if new:
                    following = _NEVER
                if entry[i] == _NEVER:  # a range begins with its marker
                    cover, resolved = following, False
                    places.append(i)
                    found.append(cover)
                elif entry[i] == _NEVER + 1:  # the exit of a range that began with another key
                    following = until[i]
                elif not resolved and entry[i] > cover:
                    following, resolved = until[i], True
            before = _key(batch, keys, batch.num_rows - 1)
            if places:
                taken = batch.take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[taken.column(k) for k in keys], taken.column("_part"), pa.array(found, pa.int64())], names)

    return run


def _fold_heads(keys: list[str], time: str, seq: str):
    """Open instants of range heads, given the cover each range was entered with."""
    names = [*keys, time, seq]

    def run(batches):
        part, cover = None, _NEVER
        for batch in batches:
            places = []
            columns = (batch.column(c).to_pylist() for c in ("_part", time, "_until", "_cover_in"))
            for i, (of, at, until, entry) in enumerate(zip(*columns)):
                if of != part:
                    part, cover = of, _NEVER if entry is None else entry
                if at > cover:
                    places.append(i)
                    cover = cover if until is None else until
            if places:
                yield pa.RecordBatch.from_arrays([batch.take(pa.array(places, pa.int64())).column(c) for c in names], names)

    return run


def anchored_windows(df: DataFrame, keys: list[str], time: str, seq: str, cover_until: Column, out: str) -> DataFrame:
    """Flag rows that are not covered by the window of the last opening row of their key.

    An uncovered row opens a window that covers later rows up to and including `cover_until` (a row with
    `cover_until` before its own time opens none). Covered rows never move the window. Rows are taken in
    (time, seq) order, `seq` unique; `time` is a whole number. Null keys are a key.

    1. Each instant is reduced to its first opening row (map-side), and instants are sorted into ranges.
    2. One pass over a range, batch by batch, settles all keys that begin in it, and reduces the part of its first key to a
       step function and what a later range may need to a number.
    3. A walk over the summaries of each key, whose number depends on ranges and not on rows, gives the cover each
       range is entered with, and a second pass settles the first keys.
    """
    rows = df.withColumn("_cover", cover_until.cast("long"))
    head = F.min_by(F.struct(F.col(seq).alias("seq"), F.col("_cover").alias("cover")), F.when(F.col("_cover") >= F.col(time), F.col(seq)))
    instants = rows.groupBy(*keys, time).agg(head.alias("_head")).select(
        *keys, F.col(time).cast("long").alias(time), F.col("_head.seq").alias(seq), F.col("_head.cover").alias("_until"))
    kinds = {f.name: f.dataType.simpleString() for f in instants.schema}
    key_kinds = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    at_kinds = f"`{time}` long, `{seq}` {kinds[seq]}"
    settled = written(
        instants.repartitionByRange(*keys, time).sortWithinPartitions(*keys, time).mapInArrow(
            _fold_range(keys, time, seq), f"{key_kinds}, _kind string, _part int, {at_kinds}, _until long"), "anchored")
    summaries = settled.filter("_kind IN ('step', 'exit')")
    entered = (
        summaries.repartition(*keys).sortWithinPartitions(*keys, "_part", F.col(time) == _NEVER + 1, time)
        .mapInArrow(_walk_ranges(keys, time), f"{key_kinds}, _part int, _cover_in long").select("_part", "_cover_in")
    )
    heads = settled.filter("_kind = 'head'").join(entered, "_part", "left").repartition("_part").sortWithinPartitions("_part", time)
    late = heads.select(*keys, "_part", time, seq, "_until", "_cover_in").mapInArrow(
        _fold_heads(keys, time, seq), f"{key_kinds}, {at_kinds}")
    opened = settled.filter("_kind = 'open'").select(*keys, time, seq).unionByName(late).select(
        *[F.col(k).alias(f"_o_{k}") for k in keys], F.col(time).alias("_o_time"), F.col(seq).alias("_open_seq"), F.lit(True).alias("_is_open"))
    test = F.col(time) == F.col("_o_time")
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    uncovered = F.col("_is_open") & (F.col("_open_seq").isNull() | (F.col(seq) <= F.col("_open_seq")))
    flagged = rows.join(opened, test, "left").withColumn(out, F.coalesce(uncovered, F.lit(False)))
    return flagged.drop("_cover", "_o_time", "_open_seq", "_is_open", *[f"_o_{k}" for k in keys])
