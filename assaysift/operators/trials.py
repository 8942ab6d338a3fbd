"""Tuning-trial tables: expanded parameters, best trials and score landscapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.functions.labels import dataset_label, feature_set_label
from assaysift.functions.numeric import coerce_number, col, finite
from assaysift.functions.ordering import choose, quantiles, running_extreme
from assaysift.functions.params import expand_params
from assaysift.operators.bins import padded_limits, width_bin
from assaysift.operators.keys import require_columns
from assaysift.operators.metrics import higher_is_better
from assaysift.operators.selection import best_first, pick_best

# Parameters shown per model family as (parameter, column, label, binning), in display order.
LANDSCAPE = {
    "ridge": (("log10_alpha", "param_log10_alpha", "log10(alpha)", "continuous"),),
    "xgboost": (
        ("log10_learning_rate", "param_log10_learning_rate", "log10(learning rate)", "continuous"),
        ("max_depth", "param_max_depth", "Max depth", "exact"),
        ("n_estimators", "param_n_estimators", "N estimators", "exact"),
        ("subsample", "param_subsample", "Subsample", "continuous"),
    ),
}
BIN_COUNT = 8
TRIAL_KEYS = ("dataset_label", "model_type", "comparison_name", "outer_fold")


def outer_trials(trace: DataFrame, metric: str = "spearman", names: list[str] | None = None) -> DataFrame:
    """Keep scored trials of outer folds for one metric, with parameters as columns."""
    required = ["selection_scope", "tuning_metric", "trial_number", "tuning_score", "model_params", "p"]
    require_columns(trace, [*TRIAL_KEYS, *required], "trial trace")
    # Filter first: parameters of other trials need no parsing.
    kept = trace.where(
        col("outer_fold").isNotNull()
        & col("selection_scope").startswith("outer_fold_")
        & (col("tuning_metric") == metric)
        & F.nanvl(col("tuning_score").cast("double"), F.lit(None)).isNotNull()
    )
    typed = kept.withColumn("outer_fold", col("outer_fold").cast("int")).withColumn(
        "trial_number", col("trial_number").cast("int")
    )
    return expand_params(typed, names=names)


def best_trials(trace: DataFrame, metric: str = "spearman", names: list[str] | None = None) -> DataFrame:
    """Return the best trial per candidate and outer fold; ties go to the earlier trial."""
    trials = outer_trials(trace, metric, names)
    order = [
        best_first(col("tuning_score"), higher_is_better(metric)),
        col("trial_number"),
        col("param_signature"),
    ]
    return pick_best(trials, TRIAL_KEYS, order)


def labelled_trials(trials: DataFrame) -> DataFrame:
    """Add display labels of feature set and dataset."""
    return trials.withColumn("feature_set_label", feature_set_label(col("comparison_name"))).withColumn(
        "target_class_label", dataset_label(col("dataset_label"))
    )


def running_best(trace: DataFrame, group: list[str], metric: str = "spearman", strategy: str = "auto") -> DataFrame:
    """Add the best score up to each trial of a study."""
    return running_extreme(
        trace, group, ["trial_number"], "tuning_score", "best_tuning_score_so_far", higher_is_better(metric), strategy
    )


def bin_number_text(value: Column) -> Column:
    """Render a number with three significant digits, whole numbers without decimals."""
    whole = F.rint(value)
    near = F.abs(value - whole) <= F.lit(1e-9) + F.lit(1e-5) * F.abs(whole)
    scientific = F.format_string("%.2e", value)
    power = F.pow(F.lit(10.0), F.lit(2) - F.floor(F.log10(F.abs(value))))
    digits = F.rint(value * power) / power
    plain = F.when(F.abs(digits) < 1e-3, F.regexp_replace(F.format_string("%.6f", digits), "0+$", "")).otherwise(
        F.regexp_replace(digits.cast("string"), r"\.0$", "")
    )
    extreme = (F.abs(digits) >= 1000) | (F.abs(digits) < 1e-4)
    general = F.when(extreme, F.regexp_replace(scientific, r"\.?0+e", "e")).otherwise(plain)
    return F.when(near, F.format_string("%d", whole.cast("long"))).otherwise(general)


def _parameter_rows(trials: DataFrame) -> DataFrame:
    """Turn each trial into one row per parameter shown for its model family."""
    specs = []
    for model_type, parameters in LANDSCAPE.items():
        for rank, (name, column, _, binning) in enumerate(parameters):
            mine = (col("model_type") == model_type) if column in trials.columns else F.lit(False)
            value = finite(column) if column in trials.columns else F.lit(None).cast("double")
            specs.append(
                F.struct(
                    F.lit(rank + 10 * list(LANDSCAPE).index(model_type)).alias("rank"),
                    F.lit(name).alias("parameter"),
                    F.lit(binning == "continuous").alias("continuous"),
                    F.when(mine, value).alias("value"),
                )
            )
    rows = trials.select(
        "dataset_label",
        "target_class_label",
        "model_type",
        "comparison_name",
        "feature_set_label",
        "p",
        "tuning_score",
        F.explode(F.array(*specs)).alias("__s"),
    )
    return rows.select("*", "__s.*").drop("__s").where("value IS NOT NULL AND tuning_score IS NOT NULL")


def score_landscape(trials: DataFrame, bins: int = BIN_COUNT, strategy: str = "auto") -> DataFrame:
    """Return median tuning score and trial count per candidate, model parameter and parameter bin.

    Continuous parameters are cut into equal widths over all datasets of their model; others bin by value. Bin bounds
    and texts are worked out on the aggregated rows.
    """
    if bins < 1:
        raise ValueError("bin_count must be at least 1")
    require_columns(
        trials, ["dataset_label", "comparison_name", "feature_set_label", "model_type", "p", "tuning_score"], "trials"
    )
    if "target_class_label" not in trials.columns:
        trials = trials.withColumn("target_class_label", dataset_label(col("dataset_label")))
    known = trials.where(col("model_type").isin(list(LANDSCAPE)))
    families = {r[0] for r in known.select("model_type").distinct().collect()}
    if not families:
        raise ValueError("No configured model-parameter inner-CV landscape rows found.")
    for model_type in sorted(families):
        require_columns(trials, [c for _, c, _, _ in LANDSCAPE[model_type]], f"trials of {model_type}")
    strategy = choose(trials, strategy)
    rows = _parameter_rows(trials.withColumn("tuning_score", coerce_number("tuning_score")))
    # One row per parameter, five at most.
    limits = rows.groupBy("rank").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lower, upper = padded_limits(F.col("lo"), F.col("hi"))
    limits = F.broadcast(limits.select("rank", lower.alias("__lo"), upper.alias("__hi")))
    placed = rows.join(limits, "rank")
    at = width_bin(col("value"), F.col("__lo"), F.col("__hi"), bins)
    placed = placed.withColumn("__bin", F.when(col("continuous"), at.cast("double")).otherwise(col("value")))
    names = ["dataset_label", "target_class_label", "model_type", "comparison_name", "feature_set_label", "p"]
    keys = [*names, "rank", "parameter", "continuous", "__lo", "__hi", "__bin"]
    medians = quantiles(placed, keys, "tuning_score", {"median_tuning_score": 0.5}, strategy, "trial_count")
    step = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    low = F.col("__bin") * step + F.col("__lo")
    high = F.when(F.col("__bin") == bins - 1, F.col("__hi")).otherwise((F.col("__bin") + 1) * step + F.col("__lo"))
    bounded = medians.withColumn(
        "parameter_bin_lower", F.when(col("continuous"), low).otherwise(F.col("__bin"))
    ).withColumn("parameter_bin_upper", F.when(col("continuous"), high).otherwise(F.col("__bin")))
    low, high = col("parameter_bin_lower"), col("parameter_bin_upper")
    span = F.concat(bin_number_text(low), F.lit(" to "), bin_number_text(high))
    shown = F.lit(None).cast("string")
    for name, _, label, _ in [spec for specs in LANDSCAPE.values() for spec in specs]:
        shown = F.when(col("parameter") == name, F.lit(label)).otherwise(shown)
    out = bounded.select(
        *names[:3],
        "rank",
        "parameter",
        shown.alias("parameter_label"),
        *names[3:],
        F.when(col("continuous"), span).otherwise(bin_number_text(low)).alias("parameter_bin"),
        F.when(col("continuous"), (low + high) / F.lit(2.0)).otherwise(low).alias("parameter_bin_sort"),
        "parameter_bin_lower",
        "parameter_bin_upper",
        "median_tuning_score",
        "trial_count",
    )
    order = ["dataset_label", "model_type", "rank", "p", "feature_set_label", "comparison_name", "parameter_bin_sort"]
    return out.orderBy(*order).drop("rank")


def present_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value; one aggregation decides."""
    counts = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[col(c) for i, c in enumerate(df.columns) if counts[f"c{i}"] > 0])


def feature_set_order(summary: DataFrame) -> DataFrame:
    """Return feature sets per dataset in display order: fewer features first, then by label."""
    require_columns(summary, ["dataset_label", "comparison_name", "p"], "feature summary")
    rows = summary.select("dataset_label", "comparison_name", "p").distinct()
    rows = rows.withColumn("feature_set_label", feature_set_label(col("comparison_name")))
    return rows.orderBy("dataset_label", "p", "feature_set_label", "comparison_name")


def metric_limits(summary: DataFrame, metric: str = "spearman") -> tuple[float, float]:
    """Return axis limits that hold zero and every mean plus or minus its deviation."""
    mean = finite(f"{metric}_mean")
    deviation = F.coalesce(finite(f"{metric}_std"), F.lit(0.0))
    row = summary.agg(F.min(mean - deviation).alias("lo"), F.max(mean + deviation).alias("hi")).first()
    if row["lo"] is None:
        return -0.5, 0.5
    low, high = min(row["lo"], 0.0), max(row["hi"], 0.0)
    padding = 0.05 if low == high else max((high - low) * 0.08, 0.03)
    low, high = low - padding, high + padding
    return (max(-1.0, low), min(1.0, high)) if metric == "spearman" else (low, high)
