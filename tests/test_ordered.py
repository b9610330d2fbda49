"""Order-dependent operators against plain loops, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from urlvane.operators import guards, navigation, ordered


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    rows = []
    for i in range(2500):
        key = rng.choice("aaaaabcd")
        rows.append((key, rng.randrange(0, 9000 if key == "a" else 200000), i, rng.choice([-1, 0, 50, 50, 700])))
    return rows


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "k string, t long, i long, w long").repartition(3).cache()


def in_order(data):
    return sorted(data, key=lambda r: (r[0], r[1], r[2]))


def windows(data, cover):
    opened, state = {}, {}
    for k, t, i, w in in_order(data):
        opened[i] = t > state.get(k, -1)
        if opened[i] and cover(t, w) >= t:
            state[k] = cover(t, w)
    return opened


@pytest.fixture(params=[4, 11])
def ranges(spark, request):
    """Ranges of about 600 rows, and of about 230: the hot key goes over many, some keys over none."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, (str(request.param), "false")):
        spark.conf.set(name, value)
    yield request.param
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def test_anchored_windows(frame, data, ranges):
    for cover, column in (
        (lambda t, w: t + 50, F.col("t") + 50), (lambda t, w: t + w, F.col("t") + F.col("w")),
        (lambda t, w: t + 40 * w, F.col("t") + 40 * F.col("w")),
    ):
        out = ordered.anchored_windows(frame, ["k"], "t", "i", column, "open")
        assert {r.i: r.open for r in out.collect()} == windows(data, cover)


def test_null_keys_and_empty_tables(spark, ranges):
    rows = [(None, t, t, 3) for t in range(40)] + [("a", t, 100 + t, 3) for t in range(0, 40, 2)]
    frame = spark.createDataFrame(rows, "k string, t long, i long, w long")
    out = ordered.anchored_windows(frame, ["k"], "t", "i", F.col("t") + 2, "open")
    assert {r.i: r.open for r in out.collect()} == {i: t % (3 if k is None else 4) == 0 for k, t, i, _ in rows}
    counted = ordered.consecutive_count(frame, ["k"], "t", "i", F.lit(True), F.col("t") % 10 == 0, "c")
    assert {r.i: r.c for r in counted.collect()} == {i: t % 10 // (1 if k is None else 2) for k, t, i, _ in rows}
    for made in (ordered.anchored_windows(frame.limit(0), ["k"], "t", "i", F.col("t"), "o"),
                 ordered.last_before(frame.limit(0), ["k"], "t", "i", F.col("w"), "o")):
        assert made.count() == 0


def test_hot_key_is_spread_over_ranges(spark, ranges):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("t"))
    sizes = [r["count"] for r in ordered.in_ranges(frame, ["k"], ["t"], "spread").groupBy("_part").count().collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("limit", [0, 1, 700, 5000])
def test_first_n(frame, data, limit):
    got = {r.i: r.ok for r in ordered.first_n(frame, ["k"], "t", "i", F.lit(limit), "ok").collect()}
    seen = {}
    for k, t, i, w in in_order(data):
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == (seen[k] <= limit)


def test_last_before_and_consecutive(frame, data, ranges):
    want, runs, last, run = {}, {}, {}, {}
    for k, t, i, w in in_order(data):
        want[i] = last.get(k)
        if w >= 50:
            last[k] = w
        run[k] = 0 if w == 700 else run.get(k, 0) + (w == 50)
        runs[i] = run[k]
    value = F.when(F.col("w") >= 50, F.col("w"))
    assert {r.i: r.p for r in ordered.last_before(frame, ["k"], "t", "i", value, "p").collect()} == want
    counted = ordered.consecutive_count(frame, ["k"], "t", "i", F.col("w") == 50, F.col("w") == 700, "c")
    assert {r.i: r.c for r in counted.collect()} == runs


def test_top_n_first_fraction_first_rows(frame, data):
    for descending in (False, True):
        got = {r.i for r in ordered.top_n_per_group(frame, ["k"], ["t", "i"], 60, descending).collect()}
        want = set()
        for k in "abcd":
            rows = sorted((t, i) for kk, t, i, _ in data if kk == k)
            want |= {i for _, i in (rows[-60:] if descending else rows[:60])}
        assert got == want
    hashed = frame.withColumn("h", F.md5(F.col("i").cast("string")))
    got = ordered.first_fraction(hashed, ["k"], "h", 0.2, "test").collect()
    for k in "abcd":
        rows = sorted((r.h, r.test) for r in got if r.k == k)
        n = -(-len(rows) // 5)
        assert [test for _, test in rows] == [True] * n + [False] * (len(rows) - n)
    firsts = {r.k: r.i for r in ordered.first_rows(frame, ["k"], "i", "first").filter("first").collect()}
    assert firsts == {k: min(i for kk, _, i, _ in data if kk == k) for k in "abcd"}


def test_dedup_golden(spark):
    rows = [(1, 1000), (2, 2500), (3, 3100), (4, 3000)]
    df = spark.createDataFrame(rows, "seq long, t long").withColumns({
        "tab_id": F.lit(1), "navigation_kind": F.lit("committed"), "document_id": F.lit(None).cast("string"), "url": F.lit("http://h.test/"),
    })
    kept = {r.seq: r.kept for r in navigation.dedup_anchored(df, "t", "seq").collect()}
    assert kept == {1: True, 2: False, 4: False, 3: True}


def test_quota_circuit_cache_goldens(spark):
    base = 1_700_000_000
    calls = spark.createDataFrame([("google_webrisk", base, 1), ("google_webrisk", base + 1, 2)], "provider string, ts long, seq long")
    assert [r.allowed for r in guards.quota_guard(calls, 1).orderBy("seq").collect()] == [True, False]
    used = spark.createDataFrame([("google_webrisk", "2023-11", 1)], "provider string, month string, used long")
    assert [r.allowed for r in guards.quota_guard(calls, 2, used=used).orderBy("seq").collect()] == [True, False]
    assert [r.allowed for r in guards.quota_guard(calls, 1, used=used).orderBy("seq").collect()] == [False, False]
    log = spark.createDataFrame(
        [("p", base, 1, "error"), ("p", base + 1, 2, None), ("q", base, 3, "error"), ("q", base + 61, 4, None), ("q", base + 60, 5, None)],
        "provider string, ts long, seq long, outcome string",
    ).filter("seq <> 5")
    assert {r.seq: r.open for r in guards.circuit_open(log, 60).collect()} == {1: False, 2: True, 3: False, 4: False}
    edge = spark.createDataFrame([("p", base, 1, "error"), ("p", base + 60, 2, "none")], "provider string, ts long, seq long, outcome string")
    assert {r.seq: r.open for r in guards.circuit_open(edge, 60).collect()} == {1: False, 2: False}
    replay = spark.createDataFrame(
        [("p", "u", base, 1, 900, "none"), ("p", "u", base + 899, 2, 900, "none"), ("p", "u", base + 900, 3, 900, "none"),
         ("other", "u", base + 1, 4, 0, "error"), ("other", "u", base + 2, 5, 900, "none")],
        "provider string, url string, ts long, seq long, ttl long, outcome string",
    )
    hits = guards.cache_replay(replay, ["provider", "url"], "ts", "seq", "ttl", F.col("outcome") == "error")
    assert {r.seq: r.cache_hit for r in hits.collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}


def guarded(rows, limit, cooldown):
    cache, until, used, out = {}, 0, {}, {}
    for provider, url, t, i, outcome, ttl in sorted(rows, key=lambda r: (r[2], r[3])):
        month = t // 2_678_400  # all rows lie in January and February 1970
        if cache.get((provider, url), 0) > t:
            out[i] = "cache_hit"
        elif provider == "g" and until > t:
            out[i] = "circuit_open"
        elif provider == "g" and used.get(month, 0) >= limit:
            out[i] = "quota_guard"
        else:
            used[month] = used.get(month, 0) + (provider == "g")
            out[i] = "error" if outcome == "error" else "called"
            if outcome == "error":
                until = t + cooldown if provider == "g" else until
            elif ttl > 0:
                cache[provider, url] = t + ttl
    return out


@pytest.mark.parametrize("limit, errors", [(120, 0.3), (60, 0.02)])
def test_guarded_lookup(spark, ranges, limit, errors):
    dice = random.Random(limit)
    rows = [(dice.choice("ggp"), dice.choice("uvwxyz"), dice.randrange(2_600_000, 2_760_000), i,
             "error" if dice.random() < errors else "none", dice.choice([0, 900, 20000])) for i in range(700)]
    log = spark.createDataFrame(rows, "provider string, url string, ts long, seq long, outcome string, ttl long").repartition(3)
    found = guards.guarded_lookup(log, limit, 3000, ["g"])
    assert found.columns == [*log.columns, "decision"]
    assert {r.seq: r.decision for r in found.collect()} == guarded(rows, limit, 3000)


def test_decisions_are_not_broadcast(spark):
    """Files of a row per lookup compress below Spark's limit for broadcasts however many lookups there are."""
    rows = [("g", "u", 60 * i, i, "none", 900) for i in range(200)]
    log = spark.createDataFrame(rows, "provider string, url string, ts long, seq long, outcome string, ttl long")
    found = guards.guarded_lookup(log, 100, 3000, ["g"])
    assert "SortMergeJoin [seq" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.seq: r.decision for r in found.collect()} == guarded(rows, 100, 3000)
