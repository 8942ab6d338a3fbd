"""Every operator applied to the benchmark tables, as (session, directory) -> DataFrame callables.

The star-schema tables stand in for screening data: parts are compounds, line numbers (by remainder) are scoring methods,
return flags are targets, brands with sizes are scaffolds, orders are assay labels with the customer's number for the
compound. All queries read the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaysift.functions import labels as lab
from assaysift.functions.numeric import col, round_half_even
from assaysift.functions.ordering import percent_rank_average, quantiles
from assaysift.functions.params import expand_params
from assaysift.operators import (
    assemble,
    bins,
    boosting,
    conformal,
    coverage,
    extrapolation,
    features,
    keys,
    metrics,
    models,
    oof,
    pairs,
    selection,
    similarity,
    splits,
    trials,
)
from assaysift.operators.linear import fold_scores, moments, solve_ridge
from assaysift.operators.tuning import score_ridge_trials, score_tree_trials
from assaysift.session import reliable_checkpoint
from assaysift.sources import registry

TARGET_OF_FLAG = {"A": "na_ph1n1", "N": "na_h3n2", "R": "na_h5n1"}
TARGET_OF_STATUS = {"F": "na_ph1n1", "O": "na_h3n2", "P": "na_h5n1"}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _choose(value: Column, pairs_: dict) -> Column:
    out = None
    for key, result in pairs_.items():
        out = F.when(value == key, F.lit(result)) if out is None else out.when(value == key, F.lit(result))
    return out


def _r(value: Column | str, digits: int = 6) -> Column:
    """Round what different engines may sum in different orders."""
    return round_half_even(col(value) if isinstance(value, str) else value, digits)


def _rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[_r(c, digits).alias(c) if c in names else col(c) for c in df.columns])


# --- screening data read off the star schema -------------------------------------------------------------------------


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long method predictions: one row per (method, id, target)."""
    rows = _table(spark, sf, "lineitem")
    method = _choose((F.col("l_linenumber") - 1) % 6, dict(enumerate(registry.METHODS)))
    return rows.groupBy(
        method.alias("method"),
        F.col("l_partkey").cast("string").alias("id"),
        _choose(F.col("l_returnflag"), TARGET_OF_FLAG).alias("target"),
    ).agg(F.max(F.floor(F.col("l_extendedprice") / 500).cast("double")).alias("prediction"), F.min("l_discount").alias("spread"))


def assay_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Label rows, several per compound and target, with their round."""
    return _table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("id"),
        _choose(F.col("o_orderstatus"), TARGET_OF_STATUS).alias("target"),
        F.concat(F.lit("round_"), (F.col("o_orderkey") % 3).cast("string")).alias("round_id"),
        ((F.floor("o_totalprice") % 50 + 1) / 8).alias("label_pkd"),
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """One label per (id, target), with metadata."""
    rows = assay_rows(spark, sf).groupBy("id", "target").agg(F.max("label_pkd").alias("label_pkd"))
    meta = keys.add_registry(rows, registry.registry_table(spark), validate=False)
    return meta.withColumn("smiles", F.concat(F.lit("C"), F.col("id")))


def compounds(spark: SparkSession, sf: str) -> DataFrame:
    """The compound library, with a brand and size for a scaffold and a type for a target class."""
    return _table(spark, sf, "part").select(
        F.lower("p_type").alias("target_class"),
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("smiles"),
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("murcko_scaffold"),
        F.when(F.col("p_size") % 5 == 0, "acyclic").otherwise("murcko").alias("scaffold_type"),
    )


def store(spark: SparkSession, sf: str) -> features.FeatureStore:
    """Feature families of the stand-in class."""
    return features.FeatureStore(predictions(spark, sf), "na", registry.class_targets("na"))


def _rank_summary(spark: SparkSession, sf: str) -> DataFrame:
    return features.rank_summary(features.method_table(predictions(spark, sf), scores=False))


def oof_rows(spark: SparkSession, sf: str, summary: DataFrame | None = None) -> DataFrame:
    """Stand-in held-out predictions: labels against a line in the consensus rank."""
    summary = _rank_summary(spark, sf) if summary is None else summary
    rows = labels(spark, sf).select("id", "target", "label_pkd").join(summary, ["id", "target"])
    rows = rows.withColumn("pred_mean", F.lit(1.0) + F.col("consensus_123_rank") * F.lit(4.0))
    rows = rows.withColumn("pred_err", F.col("method_rank_range") * F.lit(2.0))
    rows = rows.withColumn("dataset_label", F.lit("na")).withColumn("outer_fold", (F.col("id").cast("long") % 5).cast("int"))
    return oof.add_prediction_columns(rows)


def final_rows(spark: SparkSession, sf: str, summary: DataFrame | None = None) -> DataFrame:
    """Stand-in final predictions for every complete key."""
    summary = _rank_summary(spark, sf) if summary is None else summary
    flagged = keys.flag_overlap(summary, labels(spark, sf), ["id", "target"], registry.OVERLAP)
    return flagged.select(
        F.lit("na").alias("dataset_label"),
        "id",
        "target",
        (F.lit(1.0) + F.col("consensus_123_rank") * F.lit(4.0)).alias("pred_mean"),
        registry.OVERLAP,
    )


def fold_table(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in fold metrics: 3 datasets x types x 3 families x 5 folds, in exact binary fractions."""
    rows = _table(spark, sf, "lineitem").join(_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    family = _choose(F.col("p_size") % 3, {0: "ridge", 1: "xgboost", 2: "gaussian_process"})

    def fraction(column: str) -> Column:
        cents = F.sum(F.rint(F.col(column) * 100).cast("long"))
        return F.rint(cents / F.count(F.lit(1)) * 1024.0) / F.lit(1024.0)

    return rows.groupBy(
        _choose(F.col("l_returnflag"), {"A": "pa", "N": "na", "R": "fasn"}).alias("dataset_label"),
        (F.col("l_suppkey") % 5).cast("int").alias("outer_fold"),
        F.concat(F.lit("method_scores_plus_"), F.lower("p_type")).alias("comparison_name"),
        family.alias("model_type"),
        F.length("p_type").alias("p"),
        F.lit("nested").alias("tuning_mode"),
        F.lit("spearman").alias("tuning_metric"),
    ).agg(
        fraction("l_discount").alias("tuning_score"),
        F.count(F.lit(1)).alias("n_test"),
        fraction("l_tax").alias("rmse"),
        fraction("l_discount").alias("spearman"),
    )


def tuning_table(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in chosen parameters per candidate and fold."""
    folds = fold_table(spark, sf)
    text = F.concat(F.lit("{'alpha': "), (F.col("p") + F.col("outer_fold") / 4.0).cast("string"), F.lit("}"))
    return folds.withColumn("model_params", text)


def trace_table(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in trial trace with parameters as text."""
    e = _table(spark, sf, "events")
    n = F.col("event_id")
    outer = n % 7 != 0
    fold = (F.floor(n / 15) % 5).cast("int")
    ridge = F.concat(F.lit("{'alpha': "), ((n % 97 + 1) / 4.0).cast("string"), F.lit("}"))
    boosted = F.concat(
        F.lit("{'learning_rate': "),
        ((n % 29 + 1) / 128.0).cast("string"),
        F.lit(", 'max_depth': "),
        (n % 7 + 2).cast("string"),
        F.lit(", 'n_estimators': "),
        (n % 11 * 50 + 100).cast("string"),
        F.lit(", 'subsample': "),
        ((n % 33 + 32) / 64.0).cast("string"),
        F.lit("}"),
    )
    is_ridge = F.col("event_type").isin("view", "click")
    return e.select(
        _choose(F.col("user_id") % 3, {0: "pa", 1: "na", 2: "furin"}).alias("dataset_label"),
        F.when(outer, F.concat(F.lit("outer_fold_"), fold.cast("string"))).otherwise("full_labeled_data").alias("selection_scope"),
        F.when(outer, fold).alias("outer_fold"),
        _choose(n % 3, {0: "method_scores", 1: "method_ranks_plus_rank_summary", 2: "method_scores_plus_custom_block"}).alias(
            "comparison_name"
        ),
        F.when(is_ridge, "ridge").otherwise("xgboost").alias("model_type"),
        (n % 3 + 6).cast("int").alias("p"),
        F.lit("nested").alias("tuning_mode"),
        F.lit("spearman").alias("tuning_metric"),
        n.cast("int").alias("trial_number"),
        (F.rint(F.col("value")) / 1024.0).alias("tuning_score"),
        F.when(is_ridge, ridge).otherwise(boosted).alias("model_params"),
    )


PARAMETERS = ["alpha", "learning_rate", "max_depth", "n_estimators", "subsample"]


# --- queries ---------------------------------------------------------------------------------------------------------


def percentile_ranks(spark, sf, strategy="auto"):
    e = _table(spark, sf, "events").select("event_id", "event_type", "value")
    return percent_rank_average(e, ["event_type"], "value", "pct_rank", strategy)


def method_scores(spark, sf):
    return store(spark, sf).features([{"feature_set": "method_scores"}])


def method_ranks(spark, sf, strategy="auto"):
    table = features.method_table(predictions(spark, sf), scores=False, strategy=strategy)
    return table.select("id", "target", *[col(f"{m}_rank") for m in registry.METHODS])


def method_rank_summary(spark, sf):
    return store(spark, sf).features([{"feature_set": "method_rank_summary"}])


def spread_feature(spark, sf):
    return store(spark, sf).features([{"feature_set": "glide_uncertainty"}])


def target_context(spark, sf):
    return store(spark, sf).features([{"feature_set": "target_context", "base_feature_set": "method_scores"}])


def observed_target_context(spark, sf):
    base = method_scores(spark, sf)
    names = ["boltz-2_score", "balm_score"]
    return features.observed_context(base, names, registry.target_labels("na"), "na_ph1n1")


COMBINED = [
    {"feature_set": "method_scores"},
    {"feature_set": "method_ranks"},
    {"feature_set": "method_rank_summary"},
    {"feature_set": "glide_uncertainty"},
]


def combined_features(spark, sf):
    return store(spark, sf).features(COMBINED)


def training_table(spark, sf):
    return assemble.training_table(labels(spark, sf), store(spark, sf).features(COMBINED[:1]))


def inference_table(spark, sf):
    targets = F.array(*[F.lit(t) for t in registry.class_targets("na")])
    library = compounds(spark, sf).select("id", F.explode(targets).alias("target"), "smiles")
    library = keys.add_registry(library, registry.registry_table(spark), validate=False)
    return assemble.inference_table(library, store(spark, sf).features(COMBINED[:1]))


def pooled_targets(spark, sf):
    whole = labels(spark, sf)
    parts = [
        assemble.training_table(whole.where(F.col("target") == t), store(spark, sf).features(COMBINED[3:]))
        for t in registry.class_targets("na")
    ]
    return assemble.pool(parts)


def row_universe(spark, sf):
    customers = _table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    buyers = _table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    suppliers = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return keys.row_universe([customers, buyers, suppliers], ["c_custkey"])


def overlap_flag(spark, sf):
    customers = _table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    bought = _table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return keys.flag_overlap(customers, bought, ["c_custkey"], "in_orders")


def merged_predictions(spark, sf):
    scores = predictions(spark, sf)
    flags = keys.flag_overlap(
        scores.select("id", "target").distinct(), labels(spark, sf), ["id", "target"], registry.OVERLAP
    )

    def one(method: str, error: bool) -> DataFrame:
        rows = scores.where(F.col("method") == method).join(flags, ["id", "target"])
        values = [F.col("prediction").alias("pred_mean"), F.col("spread").alias("pred_err")] if error else ["prediction"]
        return rows.select("id", "target", registry.OVERLAP, *values)

    tables = {m: one(m, m in {"balm", "pignet2"}) for m in ("balm", *[m for m in registry.METHODS if m != "balm"])}
    return keys.merge_predictions(tables, ["id", "target"], registry.OVERLAP)


def candidate_diagnostics(spark, sf):
    summary = method_rank_summary(spark, sf)
    first = summary.where("method_rank_sd > 0.25").select("id", "target", "method_rank_sd")
    second = summary.where("method_rank_sd < 0.3").select("id", "target", "method_rank_sd", "branch_rank_sd")
    return keys.merge_diagnostics([first, second], ["id", "target"], registry.DISAGREEMENT_COLUMNS)


def registry_join(spark, sf):
    rows = predictions(spark, sf).select("method", "id", "target", F.lit("stale").alias("strain"))
    return keys.add_registry(rows, registry.registry_table(spark))


def unlabelled_compounds(spark, sf):
    known = assay_rows(spark, sf).select("id")
    return compounds(spark, sf).select("id", "target_class").join(known, "id", "left_anti")


def duplicate_keys(spark, sf):
    return keys.duplicate_keys(_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def assay_coverage(spark, sf):
    library = compounds(spark, sf).select("target_class", "id")
    return _rounded(coverage.library_coverage(library, assay_rows(spark, sf)), ["label_pkd_mean"])


def _covered(spark, sf):
    return coverage.library_coverage(compounds(spark, sf), assay_rows(spark, sf), validate=False)


def assay_groups(spark, sf):
    return coverage.assay_group(_covered(spark, sf)).select("id", "assay_plot_group")


def scaffold_coverage(spark, sf):
    return coverage.scaffold_coverage(_covered(spark, sf))


def scaffold_counts(spark, sf):
    counted = coverage.add_scaffold_counts(_covered(spark, sf), ["murcko_scaffold"], "assayed_any")
    return counted.select("id", "murcko_scaffold", "scaffold_library_count", "scaffold_assayed_count")


def top_scaffolds(spark, sf):
    return coverage.top_scaffolds(scaffold_coverage(spark, sf), 20)


def class_summary(spark, sf):
    return coverage.class_summary(_covered(spark, sf), scaffold_coverage(spark, sf))


def scaffold_annotations(spark, sf):
    library = compounds(spark, sf)
    scaffolds = library.select("id", "murcko_scaffold", "scaffold_type")
    return coverage.scaffold_annotations(library, assay_rows(spark, sf), scaffolds)


def cv_summary(spark, sf):
    return selection.cv_summary(fold_table(spark, sf), tuning_table(spark, sf), ["dataset_label"])


def family_summary(spark, sf):
    return _rounded(selection.family_summary(fold_table(spark, sf)), ["spearman_mean", "spearman_std"])


def fold_winners(spark, sf):
    return selection.fold_winners(fold_table(spark, sf))


def fold_winners_lowest(spark, sf):
    return selection.fold_winners(fold_table(spark, sf), "rmse", maximise=False)


_SELECTION_FLOATS = ["mean", "std", "sem"]


def candidate_cv(spark, sf):
    out = selection.candidate_cv(fold_table(spark, sf), "spearman")
    return _rounded(out, [f"spearman_{s}" for s in _SELECTION_FLOATS])


def _selection(spark, sf, metric, rule):
    out = selection.select_candidates(fold_table(spark, sf), metric, rule)
    floats = [f"{metric}_{s}" for s in _SELECTION_FLOATS] + ["best_metric_mean", "best_metric_sem", "one_se_threshold"]
    return _rounded(out, floats)


def one_se_selection(spark, sf):
    return _selection(spark, sf, "spearman", "one_se_simpler")


def one_se_selection_lowest(spark, sf):
    return _selection(spark, sf, "rmse", "one_se_simpler")


def best_mean_selection(spark, sf):
    return _selection(spark, sf, "spearman", "best_mean")


def feature_set_order(spark, sf):
    return trials.feature_set_order(family_summary(spark, sf))


def expanded_params(spark, sf):
    out = expand_params(trace_table(spark, sf), names=PARAMETERS)
    names = [f"param_{p}" for p in PARAMETERS]
    logs = ["param_log10_alpha", "param_log10_learning_rate"]
    return _rounded(out.select("trial_number", *names, *logs, "param_signature"), logs, 9)


def best_trials(spark, sf):
    out = trials.best_trials(trace_table(spark, sf), names=PARAMETERS)
    return out.select(*trials.TRIAL_KEYS, "trial_number", "tuning_score", "param_signature", "p")


def inner_trials(spark, sf):
    out = trials.labelled_trials(trials.outer_trials(trace_table(spark, sf), names=PARAMETERS))
    return out.select(*trials.TRIAL_KEYS, "trial_number", "tuning_score", "feature_set_label", "target_class_label")


def score_landscape(spark, sf, strategy="auto"):
    rows = reliable_checkpoint(trials.labelled_trials(trials.outer_trials(trace_table(spark, sf), names=PARAMETERS)))
    out = trials.score_landscape(rows, strategy=strategy)
    bounds = ["parameter_bin_sort", "parameter_bin_lower", "parameter_bin_upper", "median_tuning_score"]
    return _rounded(out, bounds)


def outer_metric_trials(spark, sf):
    folds = fold_table(spark, sf)
    best = (
        trace_table(spark, sf)
        .groupBy("dataset_label", "outer_fold")
        .agg(F.max("tuning_score").alias("tuning_score"))
    )
    candidates = folds.select("dataset_label", "outer_fold", "comparison_name", "model_type", "p", "tuning_mode")
    return selection.attach_outer_metric(candidates.join(best, ["dataset_label", "outer_fold"]), folds)


def running_best(spark, sf, strategy="auto"):
    group = ["dataset_label", "comparison_name", "model_type", "outer_fold"]
    rows = trace_table(spark, sf).where("outer_fold IS NOT NULL").select(*group, "trial_number", "tuning_score")
    return trials.running_best(rows, group, strategy=strategy)


def score_deciles(spark, sf, strategy="auto"):
    rows = _table(spark, sf, "events").select("event_id", F.col("event_type").alias("target"), F.col("value").alias("pred_mean"))
    return oof.add_score_deciles(rows, ["event_id"], strategy)


_OOF_OUT = ["label_pkd", "pred_mean", "pred_err", "pred_lower", "pred_upper", "residual", "abs_error", "covered"]


def oof_intervals(spark, sf):
    return oof_rows(spark, sf).select("dataset_label", "outer_fold", "id", "target", *_OOF_OUT)


def disagreement_bins(spark, sf):
    out = oof.prepare_oof(oof_rows(spark, sf))
    return out.select("id", "target", "selected_disagreement_bin", "dataset_display", "target_display")


def disagreement_summary(spark, sf, strategy="auto"):
    prepared = oof_rows(spark, sf).withColumn("selected_disagreement", F.col("branch_rank_sd"))
    out = oof.disagreement_summary(prepared, strategy=strategy)
    return _rounded(out, [c for c in out.columns if c.startswith(("disagreement_m", "disagreement_q", "residual", "abs"))])


_SUMMARY_FLOATS = ["spearman", "pearson", "rmse", "mae", "mean_residual", "median_abs_error", "coverage"]


def prediction_summary(spark, sf, strategy="auto"):
    return _rounded(oof.prediction_summary(oof_rows(spark, sf), strategy), _SUMMARY_FLOATS)


def _graded(spark, sf):
    scored = _table(spark, sf, "events")
    return scored.select(
        "event_id",
        "event_type",
        (F.col("user_id") % 5).cast("int").alias("fold"),
        (F.col("value") / 100 + F.col("event_id") % 3).alias("label"),
        F.col("value").alias("prediction"),
    )


def fold_metrics(spark, sf, strategy="auto"):
    out = metrics.regression_metrics(
        _graded(spark, sf), ["fold"], "label", "prediction", 2.5, [0.01, 0.05, 0.1], [10, 25, 50], ["event_id"], strategy
    )
    return _rounded(out, [c for c in out.columns if c not in {"fold", "n_test"}])


def mean_fold_metrics(spark, sf):
    return _rounded(metrics.mean_over_folds(fold_table(spark, sf), ["dataset_label"], ["rmse", "spearman"]), ["rmse", "spearman"])


def spearman_by_group(spark, sf, strategy="auto"):
    rows = _table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    out = metrics.correlations(rows, ["l_returnflag"], "l_extendedprice", "l_quantity", strategy)
    return _rounded(out, ["spearman", "pearson"])


def binary_hits(spark, sf):
    rows = labels(spark, sf)
    return rows.select("id", "target", metrics.hit(F.col("label_pkd"), 5.0).alias("hit"))


def rounded_metrics(spark, sf):
    return _rounded(_table(spark, sf, "events").select("event_id", (F.col("value") / 7).alias("value")), ["value"], 4)


def digest_folds(spark, sf, strategy="auto"):
    return splits.digest_folds(_table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 5, 42, strategy=strategy)


def _numbered(spark, sf):
    return splits.with_row_pos(_table(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_custkey"])


def random_kfold_sizes(spark, sf):
    folds = splits.random_kfold(_numbered(spark, sf), 7)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("n_ids"))


def random_kfold(spark, sf):
    return splits.random_kfold(_numbered(spark, sf), 7).select("c_custkey", "row_pos", "fold")


def random_holdout(spark, sf):
    return splits.random_holdout(_numbered(spark, sf), 0.2).select("c_custkey", "is_test")


def bootstrap_weights(spark, sf):
    drawn = splits.bootstrap_weights(_numbered(spark, sf), 3)
    return drawn.select("c_custkey", *[F.get("weights", b).alias(f"w{b}") for b in range(3)])


def value_deciles(spark, sf, strategy="auto"):
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return bins.value_bins(rows, "l_tax", "tax_bin", 10, strategy)


def group_kfold_missing(spark, sf):
    """Groups of equal size and a missing one: every fifth nation has no number."""
    nation = F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey"))
    rows = _table(spark, sf, "customer").select("c_custkey", nation.alias("c_nationkey"))
    return splits.group_kfold(rows, "c_nationkey", 3)


def group_kfold(spark, sf):
    return splits.group_kfold(_table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 5)


def random_holdout_sizes(spark, sf):
    return splits.random_holdout(_numbered(spark, sf), 0.2).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


def holdout_by_column(spark, sf):
    rows = _table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return splits.make_folds(rows, "holdout_by_column", {"holdout_column": "c_mktsegment", "holdout_values": ["BUILDING", "MACHINERY"]})


def bootstrap_totals(spark, sf):
    drawn = splits.bootstrap_weights(_numbered(spark, sf), 4)
    long = drawn.select(F.posexplode("weights").alias("replicate", "weight"))
    return long.groupBy("replicate").agg(F.sum("weight").alias("drawn"))


def poisson_bootstrap(spark, sf):
    rows = _table(spark, sf, "customer").select("c_custkey")
    weights = rows.withColumn("w", splits.poisson_weights(["c_custkey"], 3, 42))
    return weights.select("c_custkey", *[F.get("w", b).alias(f"w{b}") for b in range(3)])


def stratified_sample(spark, sf, strategy="auto"):
    rows = _table(spark, sf, "part").select("p_partkey", "p_brand")
    return splits.stratified_sample(rows, "p_brand", ["p_partkey"], 101, 7, strategy).drop("p_brand")


def rank_mapped_labels(spark, sf, strategy="auto"):
    scores = _table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    spent = _table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most"))
    templates = scores.select("c_custkey").join(spent, "c_custkey", "left").na.fill(0.0, ["most"])
    return splits.map_by_rank(scores, "c_acctbal", ["c_custkey"], templates, "most", ["c_custkey"], "label_pkd", strategy)


_X = ["l_extendedprice", "l_discount"]


def _regression_rows(spark, sf):
    return _table(spark, sf, "lineitem").select(
        *_X, "l_quantity", (F.col("l_suppkey") % 3).cast("int").alias("fold"), "l_returnflag"
    )


def feature_scaling(spark, sf):
    scaling = models.scaling_of(_regression_rows(spark, sf), _X)
    rows = [(f, round(m, 6), round(d, 6)) for f, (m, d) in scaling.items()]
    return spark.createDataFrame(rows, "feature string, mean double, scale double")


def ridge_coefficients(spark, sf):
    stats = moments(_regression_rows(spark, sf), _X, "l_quantity", ["l_returnflag"])
    rows = []
    for (flag,), per in sorted(stats.items()):
        model = solve_ridge(per[0], _X, [12.5], standardize=True)[0]
        rows.append((flag, *(float(round(v, 8)) for v in (model.intercept, *model.coefficients))))
    return spark.createDataFrame(rows, "l_returnflag string, intercept double, b_price double, b_discount double")


def ridge_predictions(spark, sf):
    rows = _regression_rows(spark, sf)
    model = models.fit(rows, "ridge", _X, "l_quantity", {"alpha": 3.0}, standardize=True)
    scored = models.predict(model, rows, "pred")
    return _rounded(
        scored.groupBy("l_returnflag").agg(F.avg("pred").alias("mean_pred"), F.max("pred").alias("max_pred")),
        ["mean_pred", "max_pred"],
    )


def ridge_trial_scores(spark, sf):
    alphas = [0.01, 1.0, 1e5]
    rows = _regression_rows(spark, sf).select(*_X, "l_quantity", "fold")
    found = score_ridge_trials(rows, "fold", _X, "l_quantity", alphas, True, "rmse", {})
    return spark.createDataFrame([(a, round(s, 6)) for a, s in zip(alphas, found, strict=True)], "alpha double, rmse double")


def ridge_fold_scores(spark, sf):
    """Error and explained share of every strength, fold and resample, from held-out moments."""
    alphas = [0.01, 1.0, 1e5]
    rows = _regression_rows(spark, sf).withColumn(
        "w", F.array(F.lit(1), (F.col("l_returnflag") == "N").cast("int"), F.when(F.col("l_returnflag") == "A", 2).otherwise(1))
    )
    stats = moments(rows, _X, "l_quantity", ["fold"], "w", 3)
    found = [
        (fold, replicate, alphas[i], round(rmse, 6), round(r2, 6))
        for fold, replicate, i, rmse, r2 in fold_scores(stats, _X, alphas, True)
    ]
    return spark.createDataFrame(found, "fold int, replicate int, alpha double, rmse double, r2 double")


def ensemble_intervals(spark, sf):
    rows = _regression_rows(spark, sf).withColumn("w", F.array((F.col("fold") == 0).cast("int"), (F.col("fold") == 1).cast("int"), (F.col("fold") == 2).cast("int")))
    members = models.fit_ensemble(rows, "ridge", _X, "l_quantity", {"alpha": 1.0}, False, "w", 3)
    scored = models.predict_ensemble(members, rows, "prediction_mean", "prediction_std")
    return _rounded(
        scored.groupBy("l_returnflag").agg(
            F.avg("prediction_mean").alias("mean_center"), F.avg("prediction_std").alias("mean_spread"), F.max("prediction_std").alias("max_spread")
        ),
        ["mean_center", "mean_spread", "max_spread"],
    )


def _calibration(spark, sf):
    e = _table(spark, sf, "events")
    return e.select(
        "event_id",
        "event_type",
        (F.col("event_id") % 5 == 0).alias("is_calibration"),
        F.col("value").alias("label"),
        (F.col("user_id") % 50).cast("double").alias("mean"),
        ((F.col("user_id") % 4) / 2.0).alias("spread"),
    )


def conformal_intervals(spark, sf, strategy="auto"):
    rows = _calibration(spark, sf)
    q = conformal.fit_multiplier(rows.where("is_calibration"), "label", "mean", "spread", 0.9, ["event_type"], strategy)
    test = rows.where("NOT is_calibration").join(q, "event_type")
    error = conformal.half_width(F.col("spread"), F.col("conformal_q"))
    out = test.withColumn("pred_err", error)
    for name, bound in conformal.interval_columns(F.col("mean"), F.col("pred_err")).items():
        out = out.withColumn(name, bound)
    inside = conformal.covered(F.col("label"), F.col("pred_lower"), F.col("pred_upper"), F.col("pred_err"))
    return out.select("event_id", _r("pred_err").alias("pred_err"), _r("pred_lower").alias("pred_lower"), _r("pred_upper").alias("pred_upper"), inside.alias("covered"))


def calibration_errors(spark, sf):
    rows = _calibration(spark, sf).where("is_calibration")
    found = conformal.calibration_errors(rows, "label", "mean", "spread", 0.9)
    names = list(found)
    return spark.createDataFrame([tuple(round(found[n], 3) for n in names)], ", ".join(f"{n} double" for n in names))


def value_quantiles(spark, sf, strategy="auto"):
    rows = _table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    out = quantiles(rows, ["l_returnflag"], "l_extendedprice", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, strategy, "n")
    return _rounded(out, ["q05", "q50", "q95"])


def target_pairs(spark, sf):
    return pairs.target_pairs(oof_rows(spark, sf), _members())


def _members():
    return {"na": [(t, s) for s in registry.STRAIN_ORDER for t in registry.class_targets("na") if t.endswith(s)]}


def oof_triplets(spark, sf, strategy="auto"):
    return pairs.oof_triplets(oof_rows(spark, sf), _members(), strategy)


def final_triplets(spark, sf, summary=None):
    return pairs.final_triplets(final_rows(spark, sf, summary), _members())


def unassayed_profile(spark, sf, strategy="auto"):
    out = pairs.unassayed_profile(final_triplets(spark, sf), strategy)
    return out.select("id", "predicted_mean_pkd", "unassayed_prediction_rank")


def pair_summary(spark, sf):
    # Held-out and final rows read the same ranks of all predictions.
    summary = reliable_checkpoint(_rank_summary(spark, sf))
    rows = reliable_checkpoint(oof_rows(spark, sf, summary))
    made = [pairs.target_pairs(rows, _members()), pairs.oof_triplets(rows, _members()), final_triplets(spark, sf, summary)]
    out = pairs.pair_summary(rows, *[reliable_checkpoint(m) for m in made], _members())
    return _rounded(out, ["spearman", "mae"])


def _documents(spark, sf):
    return _table(spark, sf, "documents").select(
        F.lit("text").alias("target_class"), F.col("doc_id").alias("id"), F.col("lang").alias("target"), similarity.word_set(F.col("text")).alias("bits")
    )


def _items(spark, sf):
    lang = _choose(F.col("item_id") % 2, {0: "en", 1: "de"})
    return _table(spark, sf, "benchmark").select(
        F.lit("text").alias("target_class"), F.col("item_id").alias("id"), lang.alias("target"), similarity.word_set(F.col("text")).alias("bits")
    )


_NEAR = ["nearest_labeled_tanimoto", "nearest_labeled_same_target_tanimoto"]


def nearest_labelled(spark, sf):
    return _rounded(similarity.nearest_labelled(_documents(spark, sf), _items(spark, sf), "bits"), _NEAR, 9)


def nearest_labelled_blocks(spark, sf):
    found = similarity.nearest_labelled(_documents(spark, sf), _items(spark, sf), "bits", force_blocks=True)
    return _rounded(found, _NEAR, 9)


def _vectors(spark, sf):
    return _table(spark, sf, "embeddings").select("vec_id", "label", similarity.positive_dimensions(F.col("embedding")).alias("bits"))


def tanimoto_distance_sums(spark, sf):
    out = similarity.distance_sums(_vectors(spark, sf), "vec_id", "bits", "label")
    return _rounded(out.select("vec_id", "cluster", "total"), ["total"])


def tanimoto_distance_sums_blocks(spark, sf):
    out = similarity.distance_sums(_vectors(spark, sf), "vec_id", "bits", "label", block_sets=64)
    return _rounded(out.select("vec_id", "cluster", "total"), ["total"])


def k_medoids(spark, sf):
    return similarity.k_medoids(_vectors(spark, sf), "vec_id", "bits", 6)


def scaffold_novelty(spark, sf):
    library = compounds(spark, sf)
    labelled = assay_rows(spark, sf).join(library.select("id", "target_class"), "id")
    return extrapolation.scaffold_novelty(library.drop("smiles"), labelled)


def _extrapolation(spark, sf):
    docs = _documents(spark, sf).drop("bits").withColumn("murcko_scaffold", F.concat(F.lit("s"), (F.col("id") % 97).cast("string")))
    labelled = _items(spark, sf).drop("bits", "target")
    novel = extrapolation.scaffold_novelty(docs.select("target_class", "id", "murcko_scaffold"), labelled)
    near = similarity.nearest_labelled(_documents(spark, sf), _items(spark, sf), "bits")
    rows = docs.select("target_class", "id", "target").join(novel, ["target_class", "id"]).join(near, ["target_class", "id", "target"])
    return extrapolation.flag_extrapolation(rows, labelled, 0.05)


def extrapolation_flags(spark, sf):
    return _extrapolation(spark, sf).select(
        "id", "unseen_scaffold_flag", "low_similarity_flag", "no_labeled_compounds_flag", "extrapolation_flag", "extrapolation_reason"
    )


def extrapolation_summary(spark, sf):
    return _rounded(extrapolation.extrapolation_summary(_extrapolation(spark, sf), "text"), ["extrapolation_fraction"])


def display_labels(spark, sf):
    rows = fold_table(spark, sf).select("dataset_label", "comparison_name", "model_type").distinct()
    return rows.select(
        "dataset_label",
        "comparison_name",
        "model_type",
        lab.dataset_label(F.col("dataset_label")).alias("dataset_display"),
        lab.feature_set_label(F.col("comparison_name")).alias("feature_set_label"),
        lab.model_label(F.col("model_type")).alias("model_label"),
        lab.candidate_label(lab.candidate_key(F.col("model_type"), F.col("comparison_name"))).alias("candidate_label"),
    )


def target_set_labels(spark, sf):
    rows = coverage.assay_coverage(assay_rows(spark, sf)).select("id", "assayed_targets")
    return rows.select("id", lab.target_set_label(F.col("assayed_targets")).alias("display_assayed_targets"))


def boosted_trees(spark, sf):
    """Facts that any fit has to show: every row scored, less error than the mean, the same predictions a second time."""
    rows = _regression_rows(spark, sf)
    params = {"n_estimators": 5, "max_depth": 3, "colsample_bytree": 1.0}
    scored = rows
    for out in ("once", "again"):
        scored = models.predict(models.fit(rows, "xgboost", _X, "l_quantity", params), scored, out)
    error = F.avg(F.pow(F.col("once") - F.col("l_quantity"), F.lit(2)))
    return scored.agg(
        F.count("once").alias("n_scored"),
        (error < F.var_pop("l_quantity")).alias("error_below_mean"),
        (F.max(F.abs(F.col("once") - F.col("again"))) < 1e-6).alias("same_on_second_fit"),
    )


def _tree_rows(spark, sf):
    """Lines with three features of few values each, one of them often missing."""
    return _table(spark, sf, "lineitem").select(
        F.col("l_discount").alias("discount"),
        F.nullif(F.col("l_linenumber").cast("double"), F.lit(3.0)).alias("line"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("y"),
        (F.col("l_suppkey") % 3).cast("int").alias("fold"),
    )


_TREE_FEATURES = ["discount", "line", "tax"]
_TREE_TRIALS = [
    {"reg_lambda": 1.0, "reg_alpha": 0.0, "learning_rate": 0.5},
    {"reg_lambda": 50.0, "reg_alpha": 20.0, "learning_rate": 1.0},
]
_ONE_SPLIT = {"n_estimators": 1, "max_depth": 1, "subsample": 1.0, "colsample_bytree": 1.0}


def boosted_splits(spark, sf):
    """First split and leaves of six fits that grow together: two sets of penalties, each without one of three folds."""
    rows = _tree_rows(spark, sf)
    scopes = [(trial, k) for trial in range(len(_TREE_TRIALS)) for k in range(3)]
    fits = [boosting.TreeFit({**_TREE_TRIALS[t], **_ONE_SPLIT}, k) for t, k in scopes]
    found = []
    for (trial, k), model in zip(scopes, boosting.fit_many(rows, _TREE_FEATURES, "y", fits, "fold"), strict=True):
        tree, rate = model.trees[0], _TREE_TRIALS[trial]["learning_rate"]
        feature = int(tree.feature[0])
        split = (None, None, None) if feature < 0 else (_TREE_FEATURES[feature], float(model.cuts[feature][tree.bin[0]]), bool(tree.missing_left[0]))
        values = (None, None, None) if feature < 0 else tuple(round(float(v), 6) for v in (tree.gain[0], *(tree.value[1:3] / rate)))
        found.append((trial, k, round(model.base, 6), *split, *values))
    return spark.createDataFrame(
        found, "trial int, fold int, base double, feature string, cut double, missing_left boolean, gain double, left_value double, right_value double"
    )


def tree_trial_scores(spark, sf):
    """Error of every tree trial, averaged over held-out folds."""
    trials = [{**t, **_ONE_SPLIT} for t in _TREE_TRIALS]
    scores = score_tree_trials(_tree_rows(spark, sf), "fold", _TREE_FEATURES, "y", trials, "rmse", {})
    return spark.createDataFrame([(i, round(s, 6)) for i, s in enumerate(scores)], "trial int, rmse double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Return all queries by name. ``*_split`` and ``*_blocks`` force the plan that large inputs take."""
    plain = [
        percentile_ranks,
        method_scores,
        method_ranks,
        method_rank_summary,
        spread_feature,
        target_context,
        observed_target_context,
        combined_features,
        training_table,
        inference_table,
        pooled_targets,
        row_universe,
        overlap_flag,
        merged_predictions,
        candidate_diagnostics,
        registry_join,
        unlabelled_compounds,
        duplicate_keys,
        assay_coverage,
        assay_groups,
        scaffold_coverage,
        scaffold_counts,
        top_scaffolds,
        class_summary,
        scaffold_annotations,
        cv_summary,
        family_summary,
        fold_winners,
        fold_winners_lowest,
        candidate_cv,
        one_se_selection,
        one_se_selection_lowest,
        best_mean_selection,
        feature_set_order,
        expanded_params,
        best_trials,
        inner_trials,
        score_landscape,
        outer_metric_trials,
        running_best,
        score_deciles,
        oof_intervals,
        disagreement_bins,
        disagreement_summary,
        prediction_summary,
        fold_metrics,
        mean_fold_metrics,
        spearman_by_group,
        binary_hits,
        rounded_metrics,
        digest_folds,
        random_kfold,
        random_kfold_sizes,
        random_holdout,
        bootstrap_weights,
        value_deciles,
        group_kfold_missing,
        group_kfold,
        random_holdout_sizes,
        holdout_by_column,
        bootstrap_totals,
        poisson_bootstrap,
        stratified_sample,
        rank_mapped_labels,
        feature_scaling,
        ridge_coefficients,
        ridge_predictions,
        ridge_trial_scores,
        ridge_fold_scores,
        ensemble_intervals,
        conformal_intervals,
        calibration_errors,
        value_quantiles,
        target_pairs,
        oof_triplets,
        final_triplets,
        unassayed_profile,
        pair_summary,
        nearest_labelled,
        nearest_labelled_blocks,
        tanimoto_distance_sums,
        tanimoto_distance_sums_blocks,
        k_medoids,
        scaffold_novelty,
        extrapolation_flags,
        extrapolation_summary,
        display_labels,
        target_set_labels,
        boosted_trees,
        boosted_splits,
        tree_trial_scores,
    ]
    out = {f.__name__: f for f in plain}
    for f in (
        percentile_ranks,
        method_ranks,
        score_landscape,
        running_best,
        score_deciles,
        disagreement_summary,
        prediction_summary,
        fold_metrics,
        spearman_by_group,
        digest_folds,
        stratified_sample,
        rank_mapped_labels,
        conformal_intervals,
        value_quantiles,
        oof_triplets,
        unassayed_profile,
    ):
        out[f"{f.__name__}_split"] = lambda spark, sf, f=f: f(spark, sf, strategy="split")
    return out
