"""Models (training, bundle, kernel scoring) and streams against their batch forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlvane import fixed_values as fv
from urlvane.ml import kernel, training
from urlvane.operators import features, metrics, navigation
from urlvane.streaming import pipelines


def test_kernel_scores(spark):
    n = len(fv.LEGACY_FEATURES)
    rng = np.random.default_rng(3)
    model = kernel.KernelRegressor(rng.normal(size=n).tolist(), (rng.random(n) + 0.5).tolist(), rng.normal(size=(4, n)).tolist(),
                                   [0.5, -2.0, 1.0, 0.25], -0.3, 0.05)
    rows = rng.integers(0, 2, size=(20, n)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], ["i", *fv.LEGACY_FEATURES])
    got = {r.i: r.score for r in kernel.score_raw_regressor(df, model).collect()}
    x = (rows - np.array(model.mean)) / np.array(model.scale)
    for i, row in enumerate(x):
        want = sum(w * np.exp(-0.05 * ((row - np.array(v)) ** 2).sum()) for w, v in zip(model.weights, model.vectors)) - 0.3
        assert got[i] == pytest.approx(abs(want), abs=1e-9)
    first = kernel.score_raw_regressor(df, model).first()
    assert (first.threshold, first.calibrated, first.model_kind) == (0.5, False, "legacy_svr")
    with pytest.raises(ValueError):
        kernel.KernelRegressor([0.0], [1.0], [[1.0]], [1.0], 0.0, 0.1).check(fv.LEGACY_FEATURES)


def test_training_bundle(spark, tmp_path):
    rows = [(f"https://site{i}.test/page/{i}", 0) for i in range(90)]
    rows += [(f"http://secure-login{i}.test/verify/account?id={i}", 1) for i in range(60)]
    rows += [("https://both.test/", 0), ("https://both.test/", 1)]
    labeled = spark.createDataFrame(rows, "url string, label int")
    model, metadata = training.train_url_model(labeled, "v1", 0.5)
    assert metadata["class_counts"] == {"0": 90, "1": 60} and metadata["conflicting_urls_excluded"] == 1
    assert metadata["metrics"]["roc_auc"] == 1.0 and metadata["metrics"]["test_rows"] == 30
    training.save_model_bundle(spark, model, metadata, str(tmp_path / "bundle"))
    again, loaded = training.load_model_bundle(spark, str(tmp_path / "bundle"))
    probe = features.url_features_modern(spark.createDataFrame(
        [("https://site500.test/page/5",), ("http://secure-login9.test/verify/account?id=1",), ("bad",)], "url string"))
    one = {r.url: r.score for r in training.score_modern(probe, model, metadata).collect()}
    two = {r.url: r.score for r in training.score_modern(probe, again, loaded, 0.9).collect()}
    assert one["bad"] is None and one["https://site500.test/page/5"] < 0.5 < one["http://secure-login9.test/verify/account?id=1"]
    assert all(two[u] == pytest.approx(v) for u, v in one.items() if v is not None)
    with pytest.raises(ValueError):
        training.train_url_model(labeled.limit(50), "v1")


def test_report_and_auc(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 0), (0.2, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    pairs = [(p, n) for p, a in rows if a for n, b in rows if not b]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert metrics.roc_auc(df).first().roc_auc == pytest.approx(want, abs=1e-9)
    report = {r["class"]: r for r in metrics.classification_report(df, 0.5).collect()}
    assert report["1"].precision == pytest.approx(2 / 3, abs=1e-9) and report["accuracy"].f1 == pytest.approx(4 / 6, abs=1e-9)


def test_stream_dedup_over_files_equals_batch(spark, tmp_path):
    """Several micro-batches in time order give what one batch gives."""
    source = tmp_path / "in"
    times = [0, 900, 2000, 2001, 5000, 6500, 7001, 7002, 12000]
    start = 1_700_000_000_000
    frame = spark.createDataFrame([(i, start + t, f"k{i % 2}") for i, t in enumerate(sorted(times * 2))], "seq long, t long, k string")
    frame = frame.withColumn("at", F.timestamp_millis("t"))
    for low, high in ((0, 4000), (4000, 7000), (7000, 99999)):
        part = frame.filter(F.col("t").between(start + low, start + high - 1))
        part.coalesce(1).write.mode("append").parquet(str(source))
    batch = {r.seq for r in navigation.dedup_anchored(frame, "t", "seq", 2000, F.col("k")).filter("kept").collect()}
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    kept = pipelines.stream_dedup(stream, "at", "t", "seq", F.col("k"), 2000)
    pipelines.write_stream(kept, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


def test_stream_guards_carry_over_batches(spark, tmp_path):
    base = 1_700_000_000
    rows = [("p", base + 10 * i, i, "error" if i == 3 else "none") for i in range(8)]
    frame = spark.createDataFrame(rows, "provider string, ts long, seq long, outcome string")
    for low in (0, 4):
        frame.filter(f"seq >= {low} AND seq < {low + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pipelines.stream_guards(stream, 6, 60, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    out = {r.seq: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [out[i].allowed for i in range(8)] == [True] * 6 + [False] * 2
    assert [out[i].open for i in range(8)] == [False] * 4 + [True] + [False] * 3


def test_state_is_cleared_and_late_rows_are_seen(spark, tmp_path):
    """After the last window's end no state is left; a row older than the lateness comes out as late and changes nothing."""
    start, day = 1_700_000_000_000, 86_400_000
    batches = [[(0, start, "a"), (1, start + 1000, "a"), (2, start + 60_000, "b")],
               [(3, start + 30_000, "a"), (4, start + 59_000, "a")],  # 3 is older than the newest less ten seconds
               [(5, start + 3 * day, "c")], [(6, start + 6 * day, "d")], [(7, start + 9 * day, "d")]]
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "seq long, t long, k string").withColumn("at", F.timestamp_millis("t"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = pipelines.stream_dedup(stream, "at", "t", "seq", F.col("k"), 2000, with_late=True)
    query = pipelines.write_stream(out, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    rows = {r.seq: r.late for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {0: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(states) > states[-1]


def test_tail_holds_back_an_incomplete_line(spark, tmp_path):
    """Three steps of appending, the last line of a step split in two; stretches shorter than a line."""
    from urlvane.sources.log_tail import tail_lines

    log, other = tmp_path / "logs" / "a.jsonl", tmp_path / "logs" / "b.jsonl"
    log.parent.mkdir()
    steps = [b"one\ntwo\nthr", b"ee\r\n\nfo\xc3", b"\xbcur" + b"x" * 70 + b"\nleft open"]
    seen = []
    for i, data in enumerate(steps):
        with open(log, "ab") as out:
            out.write(data)
        other.write_bytes(b"first\n" if i else b"")
        tail = tail_lines(spark, str(log.parent), partition_bytes=5)
        query = pipelines.write_stream(tail, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
        seen.append(sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).filter("file like '%a.jsonl'").collect()))
    whole = b"".join(steps).replace(b"\r", b"").decode().split("\n")
    assert seen == [sorted(whole[:2]), sorted(whole[:4]), sorted(whole[:5])]
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.value for r in rows if r.file.endswith("b.jsonl")] == ["first"]
    data = log.read_bytes()
    assert all(data[r.at:].startswith(r.value.encode()) for r in rows if r.file.endswith("a.jsonl"))
