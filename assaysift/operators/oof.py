"""Held-out predictions of the selected model: rows, bins and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.functions.labels import class_label, target_label
from assaysift.functions.numeric import coerce_number, col, finite, number
from assaysift.functions.ordering import average_rank, choose, multi_quantiles, null_safe_join, numbered, quantiles
from assaysift.operators.bins import quantile_bins
from assaysift.operators.conformal import covered, interval_columns
from assaysift.operators.keys import require_columns
from assaysift.operators.metrics import safe_corr
from assaysift.sources import registry

# Evidence mark, required and optional numeric columns, column order.
EVIDENCE = "outer_cv_oof_selected_after_cv"
REQUIRED = ("dataset_label", "id", "target", "label_pkd", "pred_mean")
NUMERIC = (
    "label_pkd",
    "pred_mean",
    "pred_err",
    "pred_lower",
    "pred_upper",
    "residual",
    "abs_error",
    "covered",
    "pred_score_decile",
    "target_pred_score_decile",
    "scaffold_library_count",
    "scaffold_assayed_count",
    "scaffold_coverage_fraction",
    "branch_rank_sd",
    "method_rank_sd",
    "method_rank_range",
    "structure_minus_pose_rank",
    "sequence_minus_structure_rank",
)
OUTPUT_ORDER = (
    "dataset_label",
    "evidence_type",
    "outer_fold",
    "id",
    "target",
    "target_class",
    "strain",
    "label_pkd",
    "model_type",
    "comparison_name",
    "p",
    "model_params",
    "pred_mean",
    "pred_err",
    "pred_lower",
    "pred_upper",
    "residual",
    "abs_error",
    "covered",
    "pred_score_decile",
    "target_pred_score_decile",
    "murcko_scaffold",
    "scaffold_type",
    "scaffold_library_count",
    "scaffold_assayed_count",
    "scaffold_coverage_fraction",
    "scaffold_coverage_group",
)
DEFAULT_DISAGREEMENT = "branch_rank_sd"


def prediction_columns(label: str = registry.LABEL) -> dict[str, Column]:
    """Return interval, residual and coverage expressions over ``pred_mean`` and ``pred_err``."""
    y, mean, error = number(label), number("pred_mean"), number("pred_err")
    bounds = interval_columns(mean, error)
    residual = y - mean
    return {
        **bounds,
        "residual": residual,
        "abs_error": F.abs(residual),
        "covered": covered(y, bounds["pred_lower"], bounds["pred_upper"], error),
    }


def add_prediction_columns(df: DataFrame, label: str = registry.LABEL) -> DataFrame:
    """Add interval, residual and coverage columns."""
    made = prediction_columns(label)
    kept = [col(c) for c in df.columns if c not in made]
    return df.select(*kept, *[c.alias(n) for n, c in made.items()])


def add_score_deciles(oof: DataFrame, tie_break: Sequence[str], strategy: str = "auto") -> DataFrame:
    """Add deciles of the predicted score over all rows and per target."""
    strategy = choose(oof, strategy)
    binned = quantile_bins(oof, [], "pred_mean", tie_break, "pred_score_decile", strategy=strategy)
    return quantile_bins(binned, ["target"], "pred_mean", tie_break, "target_pred_score_decile", strategy=strategy)


def order_oof(oof: DataFrame) -> DataFrame:
    """Put the known columns first, then disagreement columns, then the rest."""
    head = [c for c in OUTPUT_ORDER if c in oof.columns]
    head += [c for c in registry.DISAGREEMENT_COLUMNS if c in oof.columns]
    return oof.select(*[col(c) for c in head], *[col(c) for c in oof.columns if c not in set(head)])


def available_disagreement(oof: DataFrame) -> list[str]:
    """List disagreement columns with at least one value."""
    present = [c for c in registry.DISAGREEMENT_COLUMNS if c in oof.columns]
    if not present:
        return []
    counts = oof.agg(*[F.count(coerce_number(c)).alias(c) for c in present]).first()
    return [c for c in present if counts[c] > 0]


def prepare_oof(
    oof: DataFrame,
    disagreement: str = DEFAULT_DISAGREEMENT,
    tie_break: Sequence[str] = ("id", "target"),
    strategy: str = "auto",
) -> DataFrame:
    """Type the columns, recompute residuals, bin the chosen disagreement and add display labels."""
    require_columns(oof, REQUIRED, "oof table")
    if disagreement not in oof.columns:
        raise ValueError(
            f"no column {disagreement} to bin by; these could serve: {available_disagreement(oof)}"
        )
    strategy = choose(oof, strategy)
    typed = oof.select(*[coerce_number(c).alias(c) if c in NUMERIC else col(c) for c in oof.columns])
    if not typed.where(col(disagreement).isNotNull()).limit(1).collect():
        raise ValueError(
            f"column {disagreement} is null throughout; these could serve: {available_disagreement(typed)}"
        )
    residual = col("label_pkd") - col("pred_mean")
    out = (
        typed.withColumn("residual", residual)
        .withColumn("abs_error", F.abs(residual))
        .withColumn("selected_disagreement_column", F.lit(disagreement))
        .withColumn("selected_disagreement", col(disagreement))
    )
    out = quantile_bins(
        out,
        ["dataset_label"],
        "selected_disagreement",
        tie_break,
        "selected_disagreement_bin",
        limit_to_distinct=True,
        strategy=strategy,
    )
    out = out.withColumn("dataset_display", class_label(col("dataset_label")))
    out = out.withColumn("target_display", target_label(col("target")))
    if "target_class" in out.columns:
        out = out.withColumn("target_class_display", class_label(col("target_class")))
    return out


def prediction_summary(oof: DataFrame, strategy: str = "auto") -> DataFrame:
    """Return accuracy per dataset and per target of each dataset, in one pass over both levels."""
    require_columns(oof, ["dataset_label", "target", "label_pkd", "pred_mean", "residual", "abs_error"], "oof table")
    strategy = choose(oof, strategy)
    levels = F.array(
        F.struct(F.lit("dataset").alias("level"), F.lit("all").alias("name")),
        F.struct(F.lit("target").alias("level"), col("target").alias("name")),
    )
    rows = oof.select(
        "dataset_label",
        F.explode(levels).alias("__l"),
        coerce_number("label_pkd").alias("label_pkd"),
        coerce_number("pred_mean").alias("pred_mean"),
        coerce_number("residual").alias("residual"),
        coerce_number("abs_error").alias("abs_error"),
        (coerce_number("covered") if "covered" in oof.columns else F.lit(None).cast("double")).alias("covered"),
    ).select(
        F.col("__l.level").alias("summary_level"),
        "dataset_label",
        F.col("__l.name").alias("target"),
        "label_pkd",
        "pred_mean",
        "residual",
        "abs_error",
        "covered",
    )
    keys = ["summary_level", "dataset_label", "target"]
    both = finite("label_pkd").isNotNull() & finite("pred_mean").isNotNull()
    paired = rows.withColumn("__x", F.when(both, col("label_pkd"))).withColumn("__y", F.when(both, col("pred_mean")))
    if strategy == "split":
        paired = numbered(paired)
    ranked = average_rank(paired, keys, "__x", "__rx", strategy=strategy)
    ranked = average_rank(ranked, keys, "__y", "__ry", strategy=strategy)
    aggregates = [
        F.count(F.when(col("label_pkd").isNotNull() & col("pred_mean").isNotNull(), 1)).alias("n"),
        safe_corr(F.col("__rx"), F.col("__ry")).alias("spearman"),
        safe_corr(F.col("__x"), F.col("__y")).alias("pearson"),
        F.sqrt(F.avg(col("residual") * col("residual"))).alias("rmse"),
        F.avg("abs_error").alias("mae"),
        F.avg("residual").alias("mean_residual"),
        F.avg("covered").alias("coverage"),
    ]
    if strategy == "window":
        joined = ranked.groupBy(*keys).agg(*aggregates, F.median("abs_error").alias("median_abs_error"))
    else:
        # One row per dataset and target on either side.
        medians = quantiles(paired, keys, "abs_error", {"median_abs_error": 0.5}, strategy)
        joined = null_safe_join(ranked.groupBy(*keys).agg(*aggregates), medians, keys, "left")
    whole = col("summary_level") == "dataset"
    return joined.select(
        "summary_level",
        "dataset_label",
        class_label(col("dataset_label")).alias("dataset_display"),
        "target",
        F.when(whole, "All targets").otherwise(target_label(col("target"))).alias("target_display"),
        "n",
        "spearman",
        "pearson",
        "rmse",
        "mae",
        "mean_residual",
        "median_abs_error",
        "coverage",
    ).orderBy("dataset_display", "summary_level", "target_display")


def disagreement_summary(
    oof: DataFrame,
    disagreement: str = DEFAULT_DISAGREEMENT,
    max_bins: int = 10,
    tie_break: Sequence[str] = ("id", "target"),
    strategy: str = "auto",
) -> DataFrame:
    """Return quantiles of disagreement, residual and absolute error per disagreement bin."""
    require_columns(oof, ["dataset_label", "selected_disagreement", "residual", "abs_error"], "oof table")
    strategy = choose(oof, strategy)
    binned = quantile_bins(
        oof,
        ["dataset_label"],
        "selected_disagreement",
        tie_break,
        "disagreement_bin",
        max_bins,
        limit_to_distinct=True,
        strategy=strategy,
    ).where("disagreement_bin IS NOT NULL")
    keys = ["dataset_label", "disagreement_bin"]
    quarter = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    ends = {"min": 0.0, **quarter, "max": 1.0}
    stems = {
        "selected_disagreement": ("disagreement", ends),
        "residual": ("residual", quarter),
        "abs_error": ("abs_error", quarter),
    }
    typed = binned.select(*keys, *[coerce_number(c).alias(c) for c in stems])
    wanted = {c: {f"{stem}_{n}": p for n, p in named.items()} for c, (stem, named) in stems.items()}
    out = multi_quantiles(typed, keys, wanted, strategy, "n")
    names = [f"disagreement_{n}" for n in ends] + [f"{s}_{n}" for s in ("residual", "abs_error") for n in quarter]
    return out.select(
        "dataset_label",
        class_label(col("dataset_label")).alias("dataset_display"),
        F.lit(disagreement).alias("disagreement_column"),
        "disagreement_bin",
        "n",
        *names,
    ).orderBy("dataset_display", "disagreement_bin")
