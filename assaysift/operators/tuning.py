"""Hyper-parameter search whose trials are scored in batches by Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaysift.functions.numeric import col
from assaysift.functions.params import format_params
from assaysift.operators import boosting, models
from assaysift.operators.linear import Moments, add_moments, fold_scores, moments, solve_ridge
from assaysift.operators.metrics import higher_is_better, python_round, regression_metrics

# Columns of the trial trace.
TRACE_COLUMNS = (
    "selection_scope",
    "outer_fold",
    "comparison_name",
    "model_type",
    "p",
    "tuning_mode",
    "tuning_metric",
    "trial_number",
    "n_trials_planned",
    "tuning_score",
    "best_tuning_score_so_far",
    "model_params",
)
TRACE_SCHEMA = (
    "selection_scope string, outer_fold int, comparison_name string, model_type string, p int, tuning_mode string, "
    "tuning_metric string, trial_number int, n_trials_planned int, tuning_score double, "
    "best_tuning_score_so_far double, model_params string"
)
STARTUP_TRIALS = 10
BATCH_TRIALS = 25


class Sampler:
    """Tree-structured Parzen search over a space, proposing in batches.

    The first proposals are uniform. Later ones are drawn near good trials and kept where good trials are dense relative
    to the others.
    """

    def __init__(self, space: Mapping[str, Mapping[str, Any]], seed: int, maximise: bool):
        self.space = space
        self.rng = np.random.default_rng(seed)
        self.sign = 1.0 if maximise else -1.0
        self.points: list[dict[str, float]] = []
        self.scores: list[float] = []

    def _to_unit(self, spec: Mapping[str, Any], value: float) -> float:
        low, high = float(spec["low"]), float(spec["high"])
        if spec.get("log"):
            return (math.log(value) - math.log(low)) / (math.log(high) - math.log(low))
        return (value - low) / (high - low)

    def _from_unit(self, spec: Mapping[str, Any], u: float) -> Any:
        low, high = float(spec["low"]), float(spec["high"])
        if spec["type"] == "int":
            step = int(spec.get("step", 1))
            slots = int((high - low) // step) + 1
            return int(low) + step * min(int(u * slots), slots - 1)
        if spec["type"] != "float":
            raise ValueError(f"Unsupported search-space type: {spec['type']}")
        if spec.get("log"):
            return float(math.exp(math.log(low) + u * (math.log(high) - math.log(low))))
        return float(low + u * (high - low))

    def _propose(self, name: str) -> float:
        if len(self.scores) < STARTUP_TRIALS:
            return float(self.rng.random())
        order = np.argsort([-self.sign * s for s in self.scores])
        n_good = min(max(1, int(math.ceil(0.1 * len(order)))), 25)
        values = np.array([p[name] for p in self.points])
        good, rest = values[order[:n_good]], values[order[n_good:]]
        width = max(0.05, 1.0 / (1 + len(good)))
        draws = np.clip(self.rng.choice(good, 24) + self.rng.normal(0.0, width, 24), 0.0, 1.0)

        def density(centres: np.ndarray) -> np.ndarray:
            kernels = np.exp(-0.5 * ((draws[:, None] - centres[None, :]) / width) ** 2) / width
            return (kernels.sum(axis=1) + 1.0) / (len(centres) + 1.0)

        return float(draws[int(np.argmax(density(good) / density(rest)))])

    def ask(self, n: int) -> list[dict[str, Any]]:
        """Propose ``n`` parameter sets."""
        return [{k: self._from_unit(spec, self._propose(k)) for k, spec in self.space.items()} for _ in range(n)]

    def tell(self, params: Sequence[Mapping[str, Any]], scores: Sequence[float]) -> None:
        """Record scored trials; failed ones count as worst."""
        for p, s in zip(params, scores, strict=True):
            self.points.append({k: self._to_unit(spec, p[k]) for k, spec in self.space.items()})
            self.scores.append(-self.sign * math.inf if s is None or math.isnan(s) else s)


def score_ridge_trials(
    rows: DataFrame,
    fold: str,
    features: Sequence[str],
    label: str,
    alphas: Sequence[float],
    standardize: bool,
    metric: str,
    metric_options: Mapping[str, Any],
    stats: dict[tuple, list[Moments]] | None = None,
    keep: Sequence[str] = (),
) -> list[float | None]:
    """Score all strengths on all folds: one pass for the moments, and one for predictions only if the metric needs them."""
    stats = moments(rows, features, label, [fold]) if stats is None else stats
    if metric in ("rmse", "r2"):
        found: dict[int, list[float]] = {}
        for _, _, trial, rmse, r2 in fold_scores(stats, features, alphas, standardize):
            value = rmse if metric == "rmse" else r2
            if value is not None:
                found.setdefault(trial, []).append(value)
        return [float(np.mean(found[i])) if i in found else None for i in range(len(alphas))]
    whole = add_moments([s[0] for s in stats.values()])
    tests = [k for k in stats if k[0] is not None]
    branches = None
    for key in tests:
        trained = solve_ridge(whole - stats[key][0], features, alphas, standardize)
        branch = F.array(*[m.column() for m in trained])
        branches = F.when(col(fold) == F.lit(key[0]), branch) if branches is None else branches.when(
            col(fold) == F.lit(key[0]), branch
        )
    scored = rows.where(col(fold).isNotNull()).select(
        col(fold).alias("__fold"),
        col(label).alias("__y0"),
        *[col(k) for k in keep],
        F.posexplode(branches).alias("__trial", "__p0"),
    )
    folds = regression_metrics(scored, ["__trial", "__fold"], "__y0", "__p0", tie_break=keep, only=metric, **metric_options)
    means = {r["__trial"]: r["m"] for r in folds.groupBy("__trial").agg(F.avg(metric).alias("m")).collect()}
    return [means.get(i) for i in range(len(alphas))]


def score_tree_trials(
    rows: DataFrame,
    fold: str,
    features: Sequence[str],
    label: str,
    trials: Sequence[Mapping[str, Any]],
    metric: str,
    metric_options: Mapping[str, Any],
    keep: Sequence[str] = (),
) -> list[float | None]:
    """Score all parameter sets on all folds: their trees grow together, one job per level, and one pass scores them."""
    tests = sorted(r[0] for r in rows.where(col(fold).isNotNull()).select(col(fold)).distinct().collect())
    if not tests:
        return [None] * len(trials)
    fits = [boosting.TreeFit(models.resolve_params("xgboost", p), test) for p in trials for test in tests]
    fitted = boosting.fit_many(rows, features, label, fits, fold)
    at = F.lit(None).cast("int")
    for i, test in enumerate(tests):
        at = F.when(col(fold) == F.lit(test), i).otherwise(at)
    # Of every trial a row takes the prediction of the model that left its fold out.
    own = F.array(*[F.get("__all", F.lit(t * len(tests)) + F.col("__fold_at")) for t in range(len(trials))])
    scored = (
        rows.where(col(fold).isNotNull())
        .select(col(label).alias("__y0"), *[col(k) for k in keep], at.alias("__fold_at"), boosting.predictions(fitted).alias("__all"))
        .select("__y0", *[col(k) for k in keep], "__fold_at", F.posexplode(own).alias("__trial", "__p0"))
    )
    folds = regression_metrics(scored, ["__trial", "__fold_at"], "__y0", "__p0", tie_break=keep, only=metric, **metric_options)
    means = {r["__trial"]: r["m"] for r in folds.groupBy("__trial").agg(F.avg(metric).alias("m")).collect()}
    return [means.get(i) for i in range(len(trials))]


def score_params(
    rows: DataFrame,
    fold: str,
    features: Sequence[str],
    label: str,
    model_type: str,
    params: Mapping[str, Any] | None,
    standardize: bool,
    metric: str,
    metric_options: Mapping[str, Any],
    keep: Sequence[str] = (),
) -> float | None:
    """Score one parameter set: fit per fold on the other folds, average the metric over folds."""
    tests = sorted(r[0] for r in rows.where(col(fold).isNotNull()).select(col(fold)).distinct().collect())
    scores = []
    for test in tests:
        held = col(fold).eqNullSafe(F.lit(test))
        model = models.fit(rows.where(~held), model_type, features, label, params, standardize)
        scored = models.predict(model, rows.where(held), "__p0")
        row = regression_metrics(scored, [], label, "__p0", tie_break=keep, **metric_options).first()
        if row is not None and row[metric] is not None:
            scores.append(row[metric])
    return float(np.mean(scores)) if scores else None


def tune(
    rows: DataFrame,
    fold: str,
    features: Sequence[str],
    label: str,
    candidate: Mapping[str, Any],
    metric: str,
    metric_options: Mapping[str, Any],
    n_trials: int,
    seed: int,
    scope: Mapping[str, Any],
    keep: Sequence[str] = (),
    on_trials: Callable[[list[tuple]], None] | None = None,
) -> tuple[dict[str, Any], float | None, list[tuple]]:
    """Search the candidate's space on the given folds.

    Returns the best parameters, their score and the trace rows. Families without a space are scored once.
    """
    model_type = models.resolve_model(candidate["model_type"])
    base = dict(candidate.get("base_model_params") or {})
    standardize = bool(candidate.get("standardize_features", False))
    space = models.search_space(model_type)
    if not space:
        score = score_params(
            rows, fold, features, label, model_type, base, standardize, metric, metric_options, keep
        )
        return base, score, []
    planned = max(int(n_trials), 1)
    maximise = higher_is_better(metric)
    sampler = Sampler(space, seed, maximise)
    stats = moments(rows, features, label, [fold]) if model_type == "ridge" else None
    trace: list[tuple] = []
    best: tuple[float, dict[str, Any]] | None = None
    while len(trace) < planned:
        size = min(STARTUP_TRIALS if not trace else BATCH_TRIALS, planned - len(trace))
        asked = sampler.ask(size)
        merged = [{**base, **p} for p in asked]
        if model_type == "ridge":
            scores = score_ridge_trials(
                rows, fold, features, label, [p["alpha"] for p in merged], standardize, metric, metric_options, stats, keep
            )
        elif model_type == "xgboost":
            scores = score_tree_trials(rows, fold, features, label, merged, metric, metric_options, keep)
        else:
            scores = [
                score_params(rows, fold, features, label, model_type, p, standardize, metric, metric_options, keep)
                for p in merged
            ]
        sampler.tell(asked, [math.nan if s is None else s for s in scores])
        fresh = []
        for params, score in zip(merged, scores, strict=True):
            if score is not None and (best is None or (score > best[0] if maximise else score < best[0])):
                best = (score, params)
            fresh.append(
                (
                    scope["selection_scope"],
                    scope["outer_fold"],
                    candidate["comparison_name"],
                    candidate["model_type"],
                    int(candidate["p"]),
                    scope["tuning_mode"],
                    metric,
                    len(trace) + len(fresh),
                    planned,
                    python_round(score),
                    None if best is None else python_round(best[0]),
                    format_params(params),
                )
            )
        trace.extend(fresh)
        if on_trials is not None:
            on_trials(fresh)
    if best is None:
        return base, None, trace
    return best[1], best[0], trace
