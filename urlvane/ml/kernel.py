"""Scoring with a given kernel regressor (support vectors from elsewhere)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from urlvane import fixed_values as fv


@dataclass(frozen=True)
class KernelRegressor:
    """Scaler means and scales, support vectors, dual weights, intercept and gamma."""

    mean: Sequence[float]
    scale: Sequence[float]
    vectors: Sequence[Sequence[float]]
    weights: Sequence[float]
    intercept: float
    gamma: float
    version: str = "kernel-regressor"

    def check(self, features: Sequence[str]) -> None:
        sizes = {len(self.mean), len(self.scale), *(len(v) for v in self.vectors)}
        if sizes != {len(features)}:
            raise ValueError(f"scaler expects {len(self.mean)} features, rows have {len(features)}")
        if len(self.vectors) != len(self.weights):
            raise ValueError("one weight per support vector is needed")


def score_raw_regressor(rows: DataFrame, model: KernelRegressor, threshold: float | None = None,
                        features: Sequence[str] = tuple(fv.LEGACY_FEATURES)) -> DataFrame:
    """Absolute value of the regression output; not a probability.

    The model is a small fixed table that travels with the function; rows come in Arrow
    batches and each batch is one matrix product.
    """
    model.check(features)
    mean, scale = np.asarray(model.mean, float), np.asarray(model.scale, float)
    vectors, weights = np.asarray(model.vectors, float), np.asarray(model.weights, float)
    intercept, gamma = float(model.intercept), float(model.gamma)
    squares = (vectors**2).sum(axis=1)

    @F.pandas_udf("double")
    def kernel(columns: pd.DataFrame) -> pd.Series:
        x = (columns.to_numpy(float) - mean) / scale
        distance = (x**2).sum(axis=1)[:, None] + squares[None, :] - 2.0 * (x @ vectors.T)
        return pd.Series(np.exp(-gamma * np.maximum(distance, 0.0)) @ weights + intercept)

    return rows.withColumns({
        "score": F.abs(kernel(F.struct(*features))),
        "threshold": F.lit(fv.LEGACY_THRESHOLD if threshold is None else float(threshold)),
        "model_version": F.lit(model.version), "model_kind": F.lit(fv.LEGACY_MODEL_KIND),
        "calibrated": F.lit(False), "compatibility_mode": F.lit(True),
    })
