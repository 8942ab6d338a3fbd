"""Cross-validation summaries, winners and official model selection.

Best-of-group questions are answered by ``min_by`` over an ordering struct, which combines on the map side, rather than
by sorting each group in a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.functions.labels import candidate_key
from assaysift.functions.numeric import col, number, round_floats
from assaysift.operators.keys import require_columns, require_none, require_unique
from assaysift.operators.metrics import higher_is_better
from assaysift.operators.models import COMPLEXITY, UNKNOWN_COMPLEXITY

RULES = ("one_se_simpler", "best_mean")
CANDIDATE = ("comparison_name", "model_type", "p")
TUNED_CANDIDATE = (*CANDIDATE, "tuning_mode", "tuning_metric")


def complexity(model_type: Column) -> Column:
    """Rank model families from simple to complex."""
    out = F.lit(UNKNOWN_COMPLEXITY)
    for name, rank in COMPLEXITY.items():
        out = F.when(model_type == name, F.lit(rank)).otherwise(out)
    return out


def best_first(metric_value: Column, maximise: bool) -> Column:
    """Return an ascending sort key that puts the best metric first."""
    return -metric_value if maximise else metric_value


def pick_best(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Return the first row of each group in the given ascending order."""
    payload = F.struct(*[col(c) for c in df.columns])
    best = df.groupBy(*[col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(
        F.min_by(payload, F.struct(*order)).alias("__row")
    )
    return best.select("__row.*")


def params_by_fold(tuning: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Return, per candidate, its chosen parameters as ``fold_0={..} | fold_1={..}``."""
    rows = tuning.where(col("outer_fold").isNotNull()).withColumn("outer_fold", col("outer_fold").cast("int"))
    # A candidate has one row per outer fold.
    listed = rows.groupBy(*group, *TUNED_CANDIDATE).agg(
        F.array_sort(F.collect_list(F.struct("outer_fold", "model_params"))).alias("__folds")
    )
    text = F.array_join(
        F.transform(
            "__folds",
            lambda e: F.concat(F.lit("fold_"), e["outer_fold"].cast("string"), F.lit("="), e["model_params"]),
        ),
        " | ",
    )
    return listed.select(*group, *TUNED_CANDIDATE, text.alias("selected_model_params_by_outer_fold"))


def cv_summary(folds: DataFrame, tuning: DataFrame | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Average fold metrics per candidate, attach parameters by fold and round to four digits."""
    keys = [*group, *TUNED_CANDIDATE]
    skipped = {*keys, "outer_fold", "tuning_score"}
    metrics = [c for c in folds.columns if c not in skipped]
    means = folds.groupBy(*keys).agg(*[F.avg(number(m)).alias(m) for m in metrics])
    if tuning is not None:
        means = means.join(params_by_fold(tuning, group), keys, "left")
    else:
        means = means.withColumn("selected_model_params_by_outer_fold", F.lit(None).cast("string"))
    ordered = means.select(
        F.lit("mean_across_outer_folds").alias("summary"),
        *keys,
        *[col(m) for m in metrics],
        "selected_model_params_by_outer_fold",
    )
    return round_floats(ordered)


def family_summary(folds: DataFrame, metric: str = "spearman") -> DataFrame:
    """Return mean, sample deviation and count of a metric per dataset, model family and feature set."""
    keys = ["dataset_label", "model_type", "comparison_name", "p"]
    require_columns(folds, [*keys, metric], "fold metrics")
    value = number(metric)
    out = folds.groupBy(*keys).agg(
        F.avg(value).alias(f"{metric}_mean"),
        F.stddev_samp(value).alias(f"{metric}_std"),
        F.count(value).alias("n_folds"),
    )
    label = F.concat("dataset_label", F.lit(" | "), "model_type")
    return out.withColumn("row_label", label).orderBy("dataset_label", "model_type", "p", "comparison_name")


def fold_winners(folds: DataFrame, metric: str = "spearman", maximise: bool = True) -> DataFrame:
    """Return the winning candidate per dataset and outer fold; ties go to fewer features, then by name."""
    require_columns(folds, ["dataset_label", "outer_fold", *CANDIDATE, metric], "fold metrics")
    rows = folds.where(number(metric).isNotNull())
    best = pick_best(
        rows,
        ["dataset_label", "outer_fold"],
        [best_first(number(metric), maximise), col("p"), col("model_type"), col("comparison_name")],
    )
    winner = candidate_key(col("model_type"), col("comparison_name"))
    return best.withColumn("winner_label", winner).orderBy("dataset_label", "outer_fold")


def candidate_cv(folds: DataFrame, metric: str, group: Sequence[str] = ("dataset_label",)) -> DataFrame:
    """Return mean, deviation, fold count and standard error of a metric per candidate."""
    require_columns(folds, [*CANDIDATE, metric], "fold metrics")
    value = number(metric)
    out = folds.where(value.isNotNull()).groupBy(*group, *CANDIDATE).agg(
        F.avg(value).alias(f"{metric}_mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{metric}_std"),
        F.count(value).alias("n_outer_folds"),
    )
    sem = col(f"{metric}_std") / F.sqrt(F.greatest(col("n_outer_folds"), F.lit(1)))
    return out.withColumn(f"{metric}_sem", sem).withColumn("model_complexity_rank", complexity(col("model_type")))


def select_candidates(
    folds: DataFrame, metric: str, rule: str = "one_se_simpler", group: Sequence[str] = ("dataset_label",)
) -> DataFrame:
    """Return the candidate summary with best mean, threshold, eligibility and the official choice per dataset.

    Under ``one_se_simpler`` every candidate within one standard error of the best mean is eligible, and the one with
    the fewest features wins, then the simplest family, then the better mean, then by name.
    """
    if rule not in RULES:
        raise ValueError(f"Unsupported selection_rule: {rule}. Supported values: {sorted(RULES)}")
    maximise = higher_is_better(metric)
    summary = candidate_cv(folds, metric, group)
    mean, sem = col(f"{metric}_mean"), col(f"{metric}_sem")
    names = [col("model_type"), col("comparison_name")]
    by_mean = [best_first(mean, maximise), col("p"), col("model_complexity_rank"), *names]
    best = pick_best(summary, group, by_mean).select(
        *[col(g) for g in group],
        mean.alias("best_metric_mean"),
        sem.alias("best_metric_sem"),
        col("comparison_name").alias("best_comparison_name"),
        col("model_type").alias("best_model_type"),
        col("p").alias("best_p"),
    )
    if rule == "best_mean":
        threshold = col("best_metric_mean")
    else:
        margin = col("best_metric_sem")
        threshold = col("best_metric_mean") - margin if maximise else col("best_metric_mean") + margin
    # One row per dataset, joined back to that dataset's candidates.
    judged = summary.join(best, list(group)).withColumn("one_se_threshold", threshold)
    inside = mean >= col("one_se_threshold") if maximise else mean <= col("one_se_threshold")
    eligible = F.lit(True) if rule == "best_mean" else inside
    judged = judged.withColumn("one_se_eligible", eligible)
    order = by_mean if rule == "best_mean" else [
        col("p"),
        col("model_complexity_rank"),
        best_first(mean, maximise),
        *names,
    ]
    chosen = pick_best(judged.where("one_se_eligible"), group, order).select(
        *[col(g) for g in group], *CANDIDATE, F.lit(True).alias("official_selected")
    )
    counts = judged.groupBy(*group).agg(F.count(F.when(col("one_se_eligible"), 1)).alias("one_se_eligible_count"))
    marked = judged.join(chosen, [*group, *CANDIDATE], "left").join(counts, list(group))
    return (
        marked.withColumn("official_selected", F.coalesce("official_selected", F.lit(False)))
        .withColumn("selection_metric", F.lit(metric))
        .withColumn("selection_rule", F.lit(rule))
        .select(
            *[col(g) for g in group],
            *CANDIDATE,
            mean,
            col(f"{metric}_std"),
            "n_outer_folds",
            sem,
            "model_complexity_rank",
            "selection_metric",
            "selection_rule",
            "best_metric_mean",
            "best_metric_sem",
            "one_se_threshold",
            "one_se_eligible",
            "official_selected",
            "one_se_eligible_count",
            "best_comparison_name",
            "best_model_type",
            "best_p",
        )
    )


@dataclass(frozen=True)
class Selected:
    """The official candidate of one dataset."""

    comparison_name: str
    model_type: str
    p: int
    record: dict


def official_candidate(selection: DataFrame) -> Selected:
    """Bring the one selected row of a single-dataset selection to the driver."""
    rows = selection.where("official_selected").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"Expected exactly one selected candidate, found {len(rows)}")
    record = rows[0].asDict()
    return Selected(record["comparison_name"], record["model_type"], int(record["p"]), record)


def select_model_files(selection: DataFrame) -> DataFrame:
    """Drop the helper columns that do not belong to the saved candidate summary."""
    return selection.drop("one_se_eligible_count", "best_comparison_name", "best_model_type", "best_p")


def attach_outer_metric(selected_trials: DataFrame, folds: DataFrame, metric: str = "spearman") -> DataFrame:
    """Attach held-out fold metrics to the best tuning trials; a missing one is an error."""
    required = ["dataset_label", *CANDIDATE, "outer_fold"]
    require_columns(selected_trials, [*required, "tuning_score"], "selected trials")
    require_columns(folds, [*required, metric], "fold metrics")
    offered = [*required, "tuning_mode", "tuning_metric"]
    keys = [c for c in offered if c in selected_trials.columns and c in folds.columns]
    left = selected_trials.withColumn("outer_fold", col("outer_fold").cast("int"))
    right = folds.withColumn("outer_fold", col("outer_fold").cast("int")).select(
        *keys, number(metric).alias(f"outer_fold_{metric}")
    )
    require_unique(right, keys, "fold metrics")
    joined = left.join(right, keys, "left")
    missing = joined.where(col(f"outer_fold_{metric}").isNull())
    require_none(
        missing,
        ["dataset_label", "comparison_name", "model_type", "outer_fold"],
        "Missing outer-fold metric rows for selected tuning trials",
    )
    return joined
