"""Training, calibration and quality of the URL classifier with Spark ML."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from urlvane import fixed_values as fv
from urlvane.operators import metrics, selection
from urlvane.operators.ordered import first_fraction

BUNDLE_FORMAT = "url-model-v1"
FOLDS = 3


def stratified_split(labeled: DataFrame, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `is_test`: within each label the first ceil(fraction * n) rows by seeded hash."""
    order = F.md5(F.concat_ws("|", "url", F.lit(str(seed))))
    rows = labeled.withColumn("_order", order)
    return first_fraction(rows, ["label"], "_order", test_fraction, "is_test").drop("_order")


def _balanced(rows: DataFrame) -> DataFrame:
    """Weight n / (2 * n_class): classes count equally. The class table has two rows."""
    counts = rows.groupBy("label").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    weights = counts.select("label", (total / (F.lit(2.0) * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), "label")


ROWS_PER_PARTITION = 50_000


def _sized(rows: DataFrame, n: int) -> DataFrame:
    """Partitions of a fixed number of rows: each pass of the optimizer is one job over
    them, so neither tiny nor oversized tasks pay."""
    return rows.repartition(max(1, -(-n // ROWS_PER_PARTITION)))


def _base_model(rows: DataFrame) -> PipelineModel:
    n = rows.count()
    stages = [
        VectorAssembler(inputCols=fv.MODERN_FEATURES, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(weightCol="weight", maxIter=2000, regParam=1.0 / n, standardization=False,
                           rawPredictionCol="margin", probabilityCol="p", predictionCol="guess"),
    ]
    sized = _sized(_balanced(rows), n).persist()
    model = Pipeline(stages=stages).fit(sized)
    sized.unpersist()
    return model


def _margin(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows)
    return scored.withColumn("z", vector_to_array("margin")[1]).drop(
        "raw_features", "features", "margin", "p", "guess"
    )


def _platt(rows: DataFrame) -> tuple[float, float]:
    """Sigmoid on the held-out margin, with the usual smoothed targets.

    Each row counts once with its smoothed target t: weight t as positive, 1 - t as negative.
    """
    counts = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    high, low = (counts.p + 1.0) / (counts.p + 2.0), 1.0 / (counts.n + 2.0)
    target = F.when(F.col("label") == 1, high).otherwise(low)
    soft = rows.select("z", F.explode(F.array(
        F.struct(F.lit(1).alias("label"), target.alias("weight")),
        F.struct(F.lit(0).alias("label"), (1 - target).alias("weight")),
    )).alias("t")).select("z", "t.label", "t.weight")
    stages = [
        VectorAssembler(inputCols=["z"], outputCol="margin_vector"),
        LogisticRegression(featuresCol="margin_vector", weightCol="weight", maxIter=200, standardization=False),
    ]
    fitted = Pipeline(stages=stages).fit(_sized(soft, 2 * (counts.p + counts.n))).stages[-1]
    return float(fitted.coefficients[0]), float(fitted.intercept)


class CalibratedModel:
    """Mean of the fold models' calibrated probabilities."""

    def __init__(self, parts: list[tuple[PipelineModel, float, float]]):
        self.parts = parts

    def transform(self, rows: DataFrame, out: str = "score") -> DataFrame:
        columns = rows.columns
        for i, (model, slope, offset) in enumerate(self.parts):
            rows = _margin(model, rows)
            rows = rows.withColumn(f"_p{i}", 1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col("z") + F.lit(offset))))).drop("z")
        mean = sum((F.col(f"_p{i}") for i in range(len(self.parts))), F.lit(0.0)) / len(self.parts)
        return rows.select(*columns, mean.alias(out))


def fit_calibrated(rows: DataFrame, folds: int = FOLDS) -> CalibratedModel:
    """For each fold: fit on the others, calibrate on the fold."""
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("url"), F.lit(folds))).persist()
    parts = []
    for fold in range(folds):
        model = _base_model(rows.filter(F.col("_fold") != fold))
        parts.append((model, *_platt(_margin(model, rows.filter(F.col("_fold") == fold)))))
    rows.unpersist()
    return CalibratedModel(parts)


def train_url_model(labeled: DataFrame, version: str, threshold: float = fv.DEFAULT_THRESHOLD) -> tuple[CalibratedModel, dict]:
    """Clean, guard, split, fit, calibrate and measure; returns the model and its metadata."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    unique = selection.dedupe_labels(labeled)
    counts = unique.agg(
        F.count_if("conflict").alias("conflicts"),
        F.count_if(~F.col("conflict") & (F.col("label") == 0)).alias("n0"),
        F.count_if(~F.col("conflict") & (F.col("label") == 1)).alias("n1"),
    ).first()
    present = [n for n in (counts.n0, counts.n1) if n]
    if counts.n0 + counts.n1 < 100 or min(present, default=0) < 10:
        raise ValueError("At least 100 valid rows and 10 rows from each label are required")
    dataset = stratified_split(selection.modern_dataset(labeled)).persist()
    model = fit_calibrated(dataset.filter(~F.col("is_test")))
    tested = model.transform(dataset.filter("is_test")).persist()
    quality = metrics.roc_auc(tested).first()
    report = metrics.classification_report(tested, threshold).collect()
    fingerprint = metrics.dataset_fingerprint(labeled).first()
    metadata = {
        "format": BUNDLE_FORMAT, "model_version": version,
        "created_at": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "dataset_fingerprint": f"{fingerprint.rows}:{fingerprint.fingerprint}",
        "random_state": 42, "feature_names": fv.MODERN_FEATURES, "threshold": threshold,
        "metrics": {"roc_auc": quality.roc_auc, "test_rows": quality.positives + quality.negatives,
                    "classification_report": {r["class"]: r.asDict() for r in report}},
        "training_rows": counts.n0 + counts.n1,
        "class_counts": {"0": counts.n0, "1": counts.n1},
        "conflicting_urls_excluded": counts.conflicts,
    }
    dataset.unpersist()
    tested.unpersist()
    return model, metadata


def score_modern(rows: DataFrame, model: CalibratedModel, metadata: dict, threshold: float | None = None) -> DataFrame:
    """Probability of class 1 and the fields reported with it; rows hold the modern features.

    Rows without features (not web URLs) get no score and an error text.
    """
    limit = float(metadata["threshold"] if threshold is None else threshold)
    if not 0.0 <= limit <= 1.0:
        raise ValueError("threshold is outside 0..1")
    usable = F.col("url_length").isNotNull()
    scored = model.transform(rows.filter(usable)).unionByName(rows.filter(~usable), allowMissingColumns=True)
    return scored.withColumns({
        "score_percent": F.round(F.col("score") * 100, 2), "threshold": F.lit(limit),
        "model_version": F.lit(metadata["model_version"]), "model_kind": F.lit(fv.MODEL_KIND),
        "calibrated": F.lit(True), "compatibility_mode": F.lit(False),
    })


def save_model_bundle(spark: SparkSession, model: CalibratedModel, metadata: dict, path: str) -> None:
    """Fold pipelines, and one row of metadata as JSON."""
    import json

    for i, (pipeline, _, _) in enumerate(model.parts):
        pipeline.write().overwrite().save(f"{path}/fold-{i}")
    body = {**metadata, "calibration": [[slope, offset] for _, slope, offset in model.parts]}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model_bundle(spark: SparkSession, path: str) -> tuple[CalibratedModel, dict]:
    import json

    metadata = json.loads(spark.read.text(f"{path}/metadata").first().value)
    if metadata.get("format") != BUNDLE_FORMAT:
        raise ValueError("unsupported model bundle")
    if metadata.get("feature_names") != fv.MODERN_FEATURES:
        raise ValueError("feature schema does not match")
    if not str(metadata.get("model_version") or "").strip():
        raise ValueError("model bundle has no version")
    if not 0.0 <= float(metadata["threshold"]) <= 1.0:
        raise ValueError("threshold is outside 0..1")
    parts = [
        (PipelineModel.load(f"{path}/fold-{i}"), slope, offset)
        for i, (slope, offset) in enumerate(metadata["calibration"])
    ]
    return CalibratedModel(parts), metadata
