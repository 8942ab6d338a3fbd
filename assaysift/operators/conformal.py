"""Ensemble spread and symmetric conformal intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.functions.numeric import array_mean, array_sample_std, col
from assaysift.functions.ordering import quantiles

# Fixed value: smallest ensemble spread a residual is divided by.
EPSILON = 1e-6


def ensemble_columns(members: Column) -> tuple[Column, Column]:
    """Return mean and sample deviation of an array of member predictions."""
    mean = array_mean(members)
    return mean, array_sample_std(members, mean)


def safe_spread(spread: Column) -> Column:
    """Keep a known spread away from zero; an unknown one stays unknown."""
    return F.when(spread.isNotNull(), F.greatest(spread, F.lit(EPSILON)))


def standardized_residual(label: Column, mean: Column, spread: Column) -> Column:
    """Return the absolute residual in units of the ensemble spread."""
    return F.abs(label - mean) / safe_spread(spread)


def half_width(spread: Column, q: Column) -> Column:
    """Return the interval half-width for a fitted multiplier."""
    return q * safe_spread(spread)


def fit_multiplier(
    calibration: DataFrame,
    label: str,
    mean: str,
    spread: str,
    coverage: float,
    group: Sequence[str] = (),
    strategy: str = "auto",
) -> DataFrame:
    """Return ``conformal_q`` per group: the coverage quantile of the calibration rows' standardized residuals."""
    if not 0 < coverage < 1:
        raise ValueError("interval_coverage must be between 0 and 1")
    scored = calibration.withColumn("__z", standardized_residual(col(label), col(mean), col(spread)))
    return quantiles(scored, list(group), "__z", {"conformal_q": coverage}, strategy)


def calibration_errors(
    calibration: DataFrame, label: str, mean: str, spread: str, coverage: float, strategy: str = "auto"
) -> dict[str, float]:
    """Return medians and coverage quantile of raw and standardized calibration errors."""
    scored = calibration.withColumn("__a", F.abs(col(label) - col(mean))).withColumn(
        "__z", standardized_residual(col(label), col(mean), col(spread))
    )
    raw = quantiles(scored, [], "__a", {"raw_abs_err_median": 0.5, "raw_abs_err_q": coverage}, strategy).first()
    standard = quantiles(
        scored, [], "__z", {"standardized_err_median": 0.5, "standardized_err_q": coverage}, strategy
    ).first()
    if raw is None or raw[0] is None:
        raise ValueError("z_scores must contain at least one value")
    return {**raw.asDict(), **standard.asDict()}


def interval_columns(mean: Column, error: Column) -> dict[str, Column]:
    """Return the symmetric interval around a mean."""
    return {"pred_lower": mean - error, "pred_upper": mean + error}


def covered(label: Column, lower: Column, upper: Column, error: Column) -> Column:
    """Return 1.0 or 0.0 for a label inside or outside the closed interval, NULL without an error bar."""
    return F.when(error.isNotNull(), F.when(label.between(lower, upper), 1.0).otherwise(0.0))
