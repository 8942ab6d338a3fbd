"""Model families: ridge, boosted trees and Gaussian process behind one fit/predict interface."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaysift.functions.numeric import col, number
from assaysift.operators.boosting import TreeFit, TreeModel, fit_many, predictions
from assaysift.operators.conformal import ensemble_columns
from assaysift.operators.linear import RidgeModel, moments, solve_ridge

# Default parameters and search spaces.
DEFAULT_PARAMS: dict[str, dict[str, Any]] = {
    "gaussian_process": {"alpha": 1e-6, "normalize_y": True, "random_state": 42},
    "ridge": {"alpha": 1.0},
    "xgboost": {
        "n_estimators": 300,
        "max_depth": 4,
        "learning_rate": 0.05,
        "subsample": 0.9,
        "colsample_bytree": 0.9,
        "reg_alpha": 0.0,
        "reg_lambda": 1.0,
        "random_state": 42,
        "objective": "reg:squarederror",
    },
}
SEARCH_SPACES: dict[str, dict[str, dict[str, Any]]] = {
    "ridge": {"alpha": {"type": "float", "low": 1e-4, "high": 1e3, "log": True}},
    "xgboost": {
        "n_estimators": {"type": "int", "low": 100, "high": 600, "step": 50},
        "max_depth": {"type": "int", "low": 2, "high": 8, "step": 1},
        "learning_rate": {"type": "float", "low": 1e-3, "high": 3e-1, "log": True},
        "subsample": {"type": "float", "low": 0.5, "high": 1.0},
    },
}
COMPLEXITY = {"ridge": 0, "xgboost": 1}
UNKNOWN_COMPLEXITY = 100
ALIASES = {"gp": "gaussian_process", "xgb": "xgboost"}
# A Gaussian process solves a dense system over its training rows on the driver.
MAX_GP_ROWS = 4000


def resolve_model(model_type: str) -> str:
    """Resolve an alias and reject unknown families."""
    name = ALIASES.get(model_type, model_type)
    if name not in DEFAULT_PARAMS:
        raise ValueError(f"Unsupported model_type: {model_type}")
    return name


def resolve_params(model_type: str, params: Mapping[str, Any] | None) -> dict[str, Any]:
    """Layer parameters over the family's defaults."""
    return {**DEFAULT_PARAMS[resolve_model(model_type)], **(params or {})}


def search_space(model_type: str) -> dict[str, dict[str, Any]]:
    """Return the tuning space of a family; empty when it has none."""
    return SEARCH_SPACES.get(ALIASES.get(model_type, model_type), {})


@dataclass
class GaussianProcessModel:
    """Dense Gaussian process with a unit radial kernel; predicts mean and deviation in Arrow batches."""

    features: tuple[str, ...]
    points: np.ndarray
    factor: np.ndarray
    dual: np.ndarray
    y_mean: float
    y_scale: float
    scaling: dict[str, tuple[float, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame, mean: str, error: str | None = None) -> DataFrame:
        points, factor, dual = self.points, self.factor, self.dual
        y_mean, y_scale = self.y_mean, self.y_scale

        @F.pandas_udf("mean double, err double")
        def predict(block: pd.Series) -> pd.DataFrame:
            x = np.stack(block.to_numpy()).astype(float)
            kernel = _radial(x, points)
            half = np.linalg.solve(factor, kernel.T)
            variance = np.maximum(1.0 - (half**2).sum(axis=0), 0.0)
            return pd.DataFrame({"mean": kernel @ dual * y_scale + y_mean, "err": np.sqrt(variance) * y_scale})

        inputs = F.array(*[_scaled(f, self.scaling) for f in self.features])
        scored = df.withColumn("__gp", predict(inputs)).withColumn(mean, F.col("__gp.mean"))
        if error:
            scored = scored.withColumn(error, F.col("__gp.err"))
        return scored.drop("__gp")


def _radial(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2.0 * a @ b.T
    return np.exp(-0.5 * np.maximum(square, 0.0))


def _scaled(feature: str, scaling: Mapping[str, tuple[float, float]]):
    value = number(feature)
    if feature not in scaling:
        return value
    mean, deviation = scaling[feature]
    return (value - F.lit(mean)) / F.lit(deviation)


def scaling_of(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Return mean and population deviation per feature; a column without spread gets scale 1."""
    aggregates = []
    for i, f in enumerate(features):
        aggregates += [F.avg(number(f)).alias(f"m{i}"), F.stddev_pop(number(f)).alias(f"s{i}")]
    row = df.agg(*aggregates).first()
    return {f: (float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 0.0) or 1.0) for i, f in enumerate(features)}


def _tree_fit(params: Mapping[str, Any], **scope: Any) -> TreeFit:
    if params.get("objective", "reg:squarederror") != "reg:squarederror":
        raise ValueError(f"trees minimise the squared error, not {params['objective']}")
    return TreeFit(params, **scope)


def _fit_gp(df: DataFrame, features: Sequence[str], label: str, params: Mapping[str, Any], standardize: bool):
    scaling = scaling_of(df, features) if standardize else {}
    rows = df.select(F.array(*[_scaled(f, scaling) for f in features]).alias("x"), number(label).alias("y"))
    taken = rows.limit(MAX_GP_ROWS + 1).collect()
    if len(taken) > MAX_GP_ROWS:
        raise ValueError(f"gaussian_process is limited to {MAX_GP_ROWS} training rows; use ridge or xgboost")
    points = np.array([r["x"] for r in taken], dtype=float)
    y = np.array([r["y"] for r in taken], dtype=float)
    y_mean, y_scale = (float(y.mean()), float(y.std()) or 1.0) if params["normalize_y"] else (0.0, 1.0)
    kernel = _radial(points, points) + float(params["alpha"]) * np.eye(len(points))
    factor = np.linalg.cholesky(kernel)
    dual = np.linalg.solve(factor.T, np.linalg.solve(factor, (y - y_mean) / y_scale))
    return GaussianProcessModel(tuple(features), points, factor, dual, y_mean, y_scale, scaling)


def fit(
    df: DataFrame,
    model_type: str,
    features: Sequence[str],
    label: str,
    params: Mapping[str, Any] | None = None,
    standardize: bool = False,
    weight: str | None = None,
):
    """Fit one model; ``weight`` names a column of row multiplicities."""
    family = resolve_model(model_type)
    resolved = resolve_params(family, params)
    if family == "ridge":
        rows = df.withColumn("__w", F.array(col(weight))) if weight else df
        stats = moments(rows, features, label, weights="__w" if weight else None)[()][0]
        return solve_ridge(stats, features, [resolved["alpha"]], standardize)[0]
    if family == "xgboost":
        # Splits follow the order of values alone, so trees need no standardised features.
        rows = df.withColumn("__w", F.array(col(weight))) if weight else df
        fits = [_tree_fit(resolved, replicate=0 if weight else None)]
        return fit_many(rows, features, label, fits, weights="__w" if weight else None)[0]
    if weight:
        raise ValueError("gaussian_process does not take bootstrap weights")
    return _fit_gp(df, features, label, resolved, standardize)


def fit_ensemble(
    df: DataFrame,
    model_type: str,
    features: Sequence[str],
    label: str,
    params: Mapping[str, Any] | None,
    standardize: bool,
    weights: str,
    n_bootstrap: int,
) -> list:
    """Fit one model per resample. Ridge needs a single pass for all of them, trees one per level."""
    family = resolve_model(model_type)
    if family == "ridge":
        stats = moments(df, features, label, weights=weights, n_weights=n_bootstrap)[()]
        alpha = resolve_params(family, params)["alpha"]
        return [solve_ridge(s, features, [alpha], standardize)[0] for s in stats]
    if family == "xgboost":
        resolved = resolve_params(family, params)
        return fit_many(df, features, label, [_tree_fit(resolved, replicate=b) for b in range(n_bootstrap)], weights=weights)
    members = []
    for b in range(n_bootstrap):
        weighted = df.withColumn("__weight", F.get(col(weights), b).cast("double"))
        # Repeated rows are kept as repeated rows, as the kernel system sees them.
        copies = F.sequence(F.lit(1), F.col("__weight").cast("int"))
        drawn = weighted.where("__weight > 0").withColumn("__copy", F.explode(copies))
        members.append(fit(drawn, family, features, label, params, standardize))
    return members


def predict(model: Any, df: DataFrame, out: str, error: str | None = None) -> DataFrame:
    """Add predictions; ``error`` names the deviation column for families that have one."""
    if isinstance(model, RidgeModel):
        return df.withColumn(out, model.column())
    if isinstance(model, GaussianProcessModel):
        return model.transform(df, out, error)
    return model.transform(df, out)


def predict_ensemble(members: Sequence[Any], df: DataFrame, mean: str, spread: str) -> DataFrame:
    """Add mean and sample deviation of the members' predictions."""
    if not members:
        raise ValueError("models must contain at least one fitted ensemble member")
    if all(isinstance(m, RidgeModel) for m in members):
        scored = df.withColumn("__members", F.array(*[m.column() for m in members]))
    elif all(isinstance(m, TreeModel) for m in members):
        scored = df.withColumn("__members", predictions(members))
    else:
        scored = df
        for b, member in enumerate(members):
            scored = predict(member, scored, f"__member_{b}")
        names = [f"__member_{b}" for b in range(len(members))]
        scored = scored.withColumn("__members", F.array(*names)).drop(*names)
    center, deviation = ensemble_columns(F.col("__members"))
    return scored.withColumn(mean, center).withColumn(spread, deviation).drop("__members")
