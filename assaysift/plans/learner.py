"""The learner: feature assembly, nested cross-validation, inference, selection and held-out diagnostics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaysift.functions.numeric import col, round_floats, round_half_even
from assaysift.functions.params import format_params, parse_params
from assaysift.operators import assemble, chem, conformal, coverage, keys, models, oof, selection, splits, tuning
from assaysift.operators.features import FeatureStore
from assaysift.operators.metrics import enrichment_name, python_round, regression_metrics
from assaysift.session import reliable_checkpoint
from assaysift.sources import files, registry, sinks, tables
from assaysift.sources.results import SELECTED_FINAL, SELECTED_MANIFEST, SELECTED_OOF, SELECTED_SUMMARY

KEYS = list(registry.KEYS)
TUNING_NAMES = {None: "no_tuning", "holdout": "holdout_tuning", "nested": "nested_tuning"}
OUTER = "outer_fold"
CAVEAT = (
    "These rows were held out by the same outer folds that chose the candidate, so they flatter it; "
    "only labels of a later round test it independently."
)


@dataclass(frozen=True)
class Candidate:
    """One comparison with one model run, over lazily defined tables."""

    comparison_name: str
    model_type: str
    base_params: dict[str, Any]
    standardize: bool
    training: DataFrame
    inference: DataFrame
    features: tuple[str, ...]

    @property
    def p(self) -> int:
        return len(self.features)

    def as_dict(self) -> dict[str, Any]:
        return {
            "comparison_name": self.comparison_name,
            "model_type": self.model_type,
            "base_model_params": self.base_params,
            "standardize_features": self.standardize,
            "p": self.p,
        }


def feature_store(spark: SparkSession, job: Mapping[str, Any], target_class: str, targets: Sequence[str], need: set[str]):
    descriptors = None
    if "chemical_descriptors" in need:
        library = tables.load_library(spark, job["data_dir"], target_class)
        per_target = F.explode(F.array(*[F.lit(t) for t in targets]))
        descriptors = chem.descriptors(library).withColumn("target", per_target)
    return FeatureStore(
        tables.load_predictions(spark, job["data_dir"]),
        target_class,
        targets,
        descriptors,
        tables.spread_available(spark, job["data_dir"]) if "glide_uncertainty" in need else True,
    )


def build_datasets(
    spark: SparkSession, job: Mapping[str, Any], requests: Sequence[Mapping], store: FeatureStore, targets: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Assemble training and inference tables pooled over the targets."""
    features = store.features(requests)
    labels = assemble.pool(
        [tables.load_assay(spark, job["data_dir"], job["train_round_id"], t) for t in targets]
    )
    library = assemble.pool([tables.load_target_library(spark, job["data_dir"], t) for t in targets])
    return assemble.training_table(labels, features), assemble.inference_table(library, features)


def compose_candidates(spark: SparkSession, job: Mapping[str, Any]) -> list[Candidate]:
    """Define one candidate per comparison and model run, all over the same rows.

    Rows are those every comparison is complete on, in order of target and of the label file.
    """
    if job["dataset_mode"] == "single_target":
        targets = [job["target"]]
        target_class = registry.get_target(job["target"]).target_class
    else:
        target_class = job["target_class"]
        targets = job.get("targets") or registry.class_targets(target_class)
    need = {r[k] for c in job["comparisons"] for r in c["feature_requests"] for k in ("feature_set", "base_feature_set") if r.get(k)}
    store = feature_store(spark, job, target_class, targets, need)
    built = [build_datasets(spark, job, c["feature_requests"], store, targets) for c in job["comparisons"]]
    for i, (training, inference) in enumerate(built):
        keys.require_unique(training, KEYS, f"training[{i}]")
        keys.require_unique(inference, KEYS, f"inference[{i}]")
    shared = keys.row_universe([t for t, _ in built], KEYS)
    rank = F.lit(len(targets))
    for i, target in enumerate(targets):
        rank = F.when(col("target") == target, F.lit(i)).otherwise(rank)
    ordered = splits.with_row_pos(
        shared.select(*KEYS, rank.alias("target_rank"), tables.FILE_ORDER), ["target_rank", tables.FILE_ORDER, "id"]
    )
    rows = reliable_checkpoint(ordered.select(*KEYS, splits.ROW))
    universe = reliable_checkpoint(keys.row_universe([i for _, i in built], KEYS).select(*KEYS))
    for name, frame in (("training", rows), ("inference", universe)):
        if frame.isEmpty():
            raise ValueError(f"the comparisons have no complete {name} row in common")
    candidates = []
    for comparison, (training, inference) in zip(job["comparisons"], built, strict=True):
        features = tuple(assemble.feature_columns(training))
        # Every later pass reads the assembled rows instead of ranking and joining again.
        train = reliable_checkpoint(training.drop(tables.FILE_ORDER).join(rows, KEYS))
        infer = reliable_checkpoint(inference.join(universe, KEYS, "left_semi"))
        for run in job["model_runs"]:
            candidates.append(
                Candidate(
                    comparison["name"],
                    run["model_type"],
                    dict(run.get("model_params") or {}),
                    bool(run.get("standardize_features", job["standardize_features"])),
                    train,
                    infer,
                    features,
                )
            )
    return candidates


def check_alignment(candidates: Sequence[Candidate]) -> None:
    """Check that all candidates hold the same rows in the same positions."""
    if not candidates:
        raise ValueError("no candidate to compare")
    first = candidates[0].training.select(*KEYS, splits.ROW, registry.LABEL)
    seen = {id(candidates[0].training)}
    for candidate in candidates[1:]:
        if id(candidate.training) in seen:
            continue
        seen.add(id(candidate.training))
        other = candidate.training.select(*KEYS, splits.ROW, registry.LABEL)
        keys.require_none(
            first.exceptAll(other).union(other.exceptAll(first)), KEYS, "All candidates must share the same training rows"
        )


def _inner_fold(k: int | None) -> str:
    return "inner_full" if k is None else f"inner_{k}"


def fold_table(job: Mapping[str, Any], rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """Assign the outer fold and, for each outer train set and for all rows, the inner fold.

    Positions are renumbered within each outer train set before its inner split, so an inner split sees a table of its
    own. The result is one small keyed table used by every candidate.
    """
    out = splits.make_folds(rows.select(*KEYS, splits.ROW), job["outer_split_type"], job["outer_split_params"], OUTER)
    out = reliable_checkpoint(out)
    outer = sorted(r[0] for r in out.where(col(OUTER).isNotNull()).select(OUTER).distinct().collect())
    mode = job["tuning_mode"]
    if mode is None:
        return out, outer
    if mode == "holdout":
        kind = "random_holdout"
        params = {"validation_fraction": job["holdout_validation_fraction"], "random_state": job["tuning_random_seed"]}
    elif mode == "nested":
        kind, params = job["inner_split_type"], job["inner_split_params"]
        if kind is None or params is None:
            raise ValueError("nested tuning needs an inner split with its parameters")
    else:
        raise ValueError(f"no such way of tuning: {mode}")
    for k in [*outer, None]:
        train = out if k is None else out.where(~col(OUTER).eqNullSafe(F.lit(k)))
        renumbered = splits.with_row_pos(train.select(*KEYS, col(splits.ROW).alias("__old")), ["__old"])
        inner = splits.make_folds(renumbered, kind, params, _inner_fold(k)).select(*KEYS, _inner_fold(k))
        out = out.join(inner, KEYS, "left")
    return reliable_checkpoint(out), outer


def metric_options(job: Mapping[str, Any]) -> dict[str, Any]:
    """Return the hit-metric settings of a job."""
    return {
        "hit_threshold": job["hit_threshold_pkd"],
        "top_fractions": job["enrichment_top_fractions"] or [],
        "top_counts": [int(n) for n in job["precision_at_n_values"] or []],
    }


def metric_names(options: Mapping[str, Any]) -> list[str]:
    """List metric columns in output order."""
    names = ["rmse", "mae", "r2", "spearman"]
    if options["hit_threshold"] is not None:
        names += [enrichment_name(f) for f in options["top_fractions"]]
        names += [f"precision_at_{n}" for n in options["top_counts"]]
    return names


def _scoring_options(metric: str, options: Mapping[str, Any]) -> dict[str, Any]:
    """Keep hit metrics out of tuning jobs that do not score by them."""
    return dict(options) if metric.startswith(("ef_", "precision_at_")) else {}


def tune_candidate(
    job: Mapping[str, Any], candidate: Candidate, rows: DataFrame, k: int | None, on_trials=None
) -> tuple[dict[str, Any], float | None, dict[str, Any]]:
    """Choose parameters on one outer train set (or on all rows) and return them with their score and record."""
    mode = job["tuning_mode"]
    metric = job["tuning_metric"]
    trace: list[tuple] = []
    if mode is None:
        params, score, used = candidate.base_params, None, False
    else:
        scope = {
            "selection_scope": "full_labeled_data" if k is None else f"outer_fold_{k}",
            "outer_fold": k,
            "tuning_mode": mode,
        }
        params, score, trace = tuning.tune(
            rows,
            _inner_fold(k),
            candidate.features,
            registry.LABEL,
            candidate.as_dict(),
            metric,
            _scoring_options(metric, metric_options(job)),
            job["tuning_n_trials"],
            job["tuning_random_seed"],
            scope,
            KEYS,
            on_trials,
        )
        used = bool(trace)
    record = {
        "outer_fold": k,
        "comparison_name": candidate.comparison_name,
        "model_type": candidate.model_type,
        "p": candidate.p,
        "tuning_mode": "no_tuning" if mode is None else mode,
        "tuning_metric": metric,
        "tuning_score": python_round(score),
        "n_trials": len(trace),
        "used_tuning": used,
        "model_params": format_params(params),
    }
    return params, score, record


TUNING_SCHEMA = (
    "outer_fold int, comparison_name string, model_type string, p int, tuning_mode string, tuning_metric string, "
    "tuning_score double, n_trials int, used_tuning boolean, model_params string"
)


def evaluate_candidate(
    job: Mapping[str, Any], candidate: Candidate, folds: DataFrame, outer: Sequence[int], on_trials=None
) -> tuple[list[dict], list[dict], dict[int, dict]]:
    """Tune, fit and predict per outer fold, then score all folds in one job."""
    options = metric_options(job)
    rows = candidate.training.drop(splits.ROW).join(folds, KEYS)
    records, chosen, parts = [], {}, []
    for k in outer:
        held = col(OUTER).eqNullSafe(F.lit(k))
        train = rows.where(~held)
        params, _, record = tune_candidate(job, candidate, train, k, on_trials)
        model = models.fit(train, candidate.model_type, candidate.features, registry.LABEL, params, candidate.standardize)
        scored = models.predict(model, rows.where(held), "prediction")
        parts.append(scored.select(*KEYS, OUTER, registry.LABEL, "prediction"))
        records.append(record)
        chosen[k] = params
    predicted = assemble.pool(parts)
    found = {
        r[OUTER]: r.asDict()
        for r in regression_metrics(
            predicted, [OUTER], registry.LABEL, "prediction", tie_break=KEYS, **options
        ).collect()
    }
    sizes = {r[0]: r[1] for r in rows.groupBy(OUTER).agg(F.count(F.lit(1))).collect()}
    total = sum(sizes.values())
    fold_rows = []
    for k, record in zip(outer, records, strict=True):
        fold_rows.append(
            {
                "outer_fold": k,
                **{c: record[c] for c in ("comparison_name", "model_type", "p", "tuning_mode", "tuning_metric", "tuning_score")},
                "n_train": total - sizes[k],
                "n_test": sizes[k],
                **{m: python_round(found[k][m]) for m in metric_names(options)},
            }
        )
    return fold_rows, records, chosen


def _small_frame(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: str) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def fold_schema(options: Mapping[str, Any]) -> str:
    """Return the schema of the fold table."""
    head = (
        "outer_fold int, comparison_name string, model_type string, p int, tuning_mode string, tuning_metric string, "
        "tuning_score double, n_train long, n_test long"
    )
    return ", ".join([head, *[f"{m} double" for m in metric_names(options)]])


def conformal_predictions(
    candidate: Candidate,
    train: DataFrame,
    test: DataFrame,
    params: Mapping[str, Any],
    calibration_fraction: float,
    n_bootstrap: int,
    coverage_level: float,
    split_seed: int,
    ensemble_seed: int,
) -> tuple[DataFrame, dict[str, Any]]:
    """Fit a bootstrap ensemble on part of the rows, calibrate it on the rest, and predict with error bars.

    ``train`` carries ``row_pos``; positions are renumbered within it and within its proper part.
    """
    renumbered = splits.with_row_pos(train.withColumnRenamed(splits.ROW, "__old"), ["__old"])
    halves = reliable_checkpoint(splits.random_holdout(renumbered, calibration_fraction, split_seed, "__cal"))
    proper = splits.with_row_pos(halves.where("NOT __cal").drop("__old").withColumnRenamed(splits.ROW, "__old"), ["__old"])
    proper = reliable_checkpoint(splits.bootstrap_weights(proper, n_bootstrap, ensemble_seed, "__weights"))
    calibration = halves.where("__cal")
    members = models.fit_ensemble(
        proper,
        candidate.model_type,
        candidate.features,
        registry.LABEL,
        params,
        candidate.standardize,
        "__weights",
        n_bootstrap,
    )
    scored = models.predict_ensemble(members, calibration, "prediction_mean", "prediction_std")
    q = conformal.fit_multiplier(scored, registry.LABEL, "prediction_mean", "prediction_std", coverage_level).first()[0]
    predicted = models.predict_ensemble(members, test, "pred_mean", "__spread")
    predicted = predicted.withColumn("pred_err", conformal.half_width(col("__spread"), F.lit(float(q)))).drop("__spread")
    facts = {
        "oof_prediction_mode": "adaptive_conformal",
        "n_proper_train": proper.count(),
        "n_calibration": calibration.count(),
        "conformal_q": float(q),
    }
    return predicted, facts


def candidate_inference(job: Mapping[str, Any], candidate: Candidate, params: Mapping[str, Any]) -> DataFrame:
    """Fit on all labels and predict the library: point predictions or calibrated intervals, with the overlap flag."""
    mode = job["inference_mode"]
    if mode == "point":
        model = models.fit(
            candidate.training, candidate.model_type, candidate.features, registry.LABEL, params, candidate.standardize
        )
        native = isinstance(model, models.GaussianProcessModel)
        out = models.predict(model, candidate.inference, "pred_mean" if native else "prediction", "pred_err" if native else None)
        values = ["pred_mean", "pred_err"] if native else ["prediction"]
    elif mode == "adaptive_conformal":
        seed = int(job["inference_random_seed"])
        out, _ = conformal_predictions(
            candidate,
            candidate.training,
            candidate.inference,
            params,
            job["calibration_fraction"],
            job["ensemble_size_m"],
            job["interval_coverage"],
            seed,
            seed + 1,
        )
        values = ["pred_mean", "pred_err"]
    else:
        raise ValueError(f"no such way of inference: {mode}")
    rounded = out.select(*KEYS, *[round_half_even(col(v)).alias(v) for v in values])
    return keys.flag_overlap(rounded, candidate.training, KEYS, registry.OVERLAP)


def oof_table(
    job: Mapping[str, Any],
    label: str,
    candidate: Candidate,
    candidates: Sequence[Candidate],
    folds: DataFrame,
    outer: Sequence[int],
    params_by_fold: Mapping[int, Mapping[str, Any]],
) -> DataFrame:
    """Predict every outer fold with the selected candidate and annotate the rows."""
    rows = candidate.training.join(folds.select(*KEYS, OUTER), KEYS)
    seed = int(job["inference_random_seed"])
    parts = []
    for k in outer:
        held = col(OUTER).eqNullSafe(F.lit(k))
        params = params_by_fold[k]
        if job["inference_mode"] == "adaptive_conformal":
            scored, facts = conformal_predictions(
                candidate,
                rows.where(~held),
                rows.where(held),
                params,
                job["calibration_fraction"],
                job["ensemble_size_m"],
                job["interval_coverage"],
                seed,
                seed + int(k) + 1,
            )
        else:
            model = models.fit(
                rows.where(~held), candidate.model_type, candidate.features, registry.LABEL, params, candidate.standardize
            )
            scored = models.predict(model, rows.where(held), "pred_mean", "pred_err")
            if "pred_err" not in scored.columns:
                scored = scored.withColumn("pred_err", F.lit(None).cast("double"))
            facts = {"oof_prediction_mode": "point"}
        known = [c for c in ("id", "target", "target_class", "strain", registry.LABEL) if c in scored.columns]
        parts.append(
            scored.select(
                F.lit(label).alias("dataset_label"),
                F.lit(oof.EVIDENCE).alias("evidence_type"),
                F.lit(int(k)).alias("outer_fold"),
                *known,
                F.lit(candidate.model_type).alias("model_type"),
                F.lit(candidate.comparison_name).alias("comparison_name"),
                F.lit(candidate.p).alias("p"),
                F.lit(format_params(params)).alias("model_params"),
                "pred_mean",
                "pred_err",
                *[F.lit(v).alias(n) for n, v in facts.items()],
            )
        )
    out = oof.add_prediction_columns(assemble.pool(parts))
    frames = {id(c.training): c.training for c in candidates}
    diagnostics = keys.merge_diagnostics(list(frames.values()), KEYS, registry.DISAGREEMENT_COLUMNS)
    if diagnostics is not None:
        out = out.join(diagnostics, KEYS, "left")
    if "smiles" in candidate.inference.columns:
        library = chem.unique_compounds(candidate.inference)
        scaffolds = chem.scaffolds(library) if chem.available() else None
        out = out.join(coverage.scaffold_annotations(library, candidate.training, scaffolds), "id", "left")
    out = oof.add_score_deciles(reliable_checkpoint(out), KEYS)
    return round_floats(oof.order_oof(out))


def evaluation_stem(label: str, split_type: str, tuning_mode: str | None) -> str:
    """Return the file stem of the evaluation tables."""
    stem = f"{label}_{split_type}_cv"
    return stem if tuning_mode is None else f"{stem}_{TUNING_NAMES[tuning_mode]}"


def run_job(spark: SparkSession, job: Mapping[str, Any]) -> dict[str, Any]:
    """Run one learner job and write all of its outputs."""
    label = job["output_label"]
    root = files.join(job["results_dir"], job["train_round_id"])
    sinks.write_yaml(spark, dict(job), files.join(root, "configs", f"{label}_resolved_config.yml"))
    stem = files.join(
        root, "evaluation", evaluation_stem(label, job["outer_split_type"], job["tuning_mode"])
    )
    options = metric_options(job)
    candidates = compose_candidates(spark, job)
    check_alignment(candidates)
    folds, outer = fold_table(job, candidates[0].training)

    trace_path = f"{stem}_trace.csv"
    empty = spark.createDataFrame([], tuning.TRACE_SCHEMA)
    sinks.write_csv(empty, trace_path, small=True)

    def on_trials(rows: list[tuple]) -> None:
        batch = spark.createDataFrame(rows, tuning.TRACE_SCHEMA).coalesce(1)
        batch.write.mode("append").option("header", True).option("escape", '"').csv(trace_path)

    fold_rows, tuning_rows, chosen = [], [], {}
    for i, candidate in enumerate(candidates):
        f, t, chosen[i] = evaluate_candidate(job, candidate, folds, outer, on_trials)
        fold_rows += f
        tuning_rows += t
    fold_df = _small_frame(spark, fold_rows, fold_schema(options))
    tuning_df = _small_frame(spark, tuning_rows, TUNING_SCHEMA)
    sinks.write_csv(fold_df.coalesce(1).orderBy(OUTER), f"{stem}_fold_metrics.csv", small=True)
    summary = selection.cv_summary(fold_df, tuning_df).orderBy("comparison_name", "model_type", "p")
    sinks.write_csv(summary, f"{stem}_summary.csv", small=True)

    final_rows, inference_paths, final_params = [], {}, {}
    for i, candidate in enumerate(candidates):
        rows = candidate.training.join(folds.drop(splits.ROW), KEYS)
        final_params[i], _, record = tune_candidate(job, candidate, rows, None, on_trials)
        final_rows.append({"selection_scope": "full_labeled_data", **record})
        name = f"{label}_{candidate.comparison_name}_{candidate.model_type}_inference.csv"
        path = files.join(root, "inference", name)
        sinks.write_csv(candidate_inference(job, candidate, final_params[i]), path)
        inference_paths[(candidate.comparison_name, candidate.model_type)] = path
    named = {
        f"{c}_{m}": _read_inference(spark, path) for (c, m), path in inference_paths.items()
    }
    merged_path = files.join(root, "inference", f"{label}_merged_inference_predictions.csv")
    sinks.write_csv(keys.merge_predictions(named, KEYS, registry.OVERLAP), merged_path)

    outputs = None
    if job["write_selected_outputs"]:
        outputs = write_selected(
            spark, job, root, candidates, folds, outer, fold_df, chosen, final_params, inference_paths
        )
    return {
        "dataset_label": label,
        "candidates": candidates,
        "fold_df": fold_df,
        "summary_df": summary,
        "tuning_df": tuning_df,
        "final_tuning": final_rows,
        "selected": outputs,
        "fold_path": f"{stem}_fold_metrics.csv",
        "summary_path": f"{stem}_summary.csv",
        "trace_path": trace_path,
        "inference_paths": inference_paths,
        "merged_inference_path": merged_path,
    }


def _read_inference(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.option("header", True).option("escape", '"').csv(path)
    return table.select(*KEYS, *[col(c).cast("double").alias(c) if c != registry.OVERLAP else col(c).cast("int") for c in table.columns if c not in KEYS])


def write_selected(
    spark: SparkSession,
    job: Mapping[str, Any],
    root: str,
    candidates: Sequence[Candidate],
    folds: DataFrame,
    outer: Sequence[int],
    fold_df: DataFrame,
    chosen: Mapping[int, Mapping[int, dict]],
    final_params: Mapping[int, dict],
    inference_paths: Mapping[tuple[str, str], str],
) -> dict[str, Any]:
    """Select the official candidate and write its summary, predictions, held-out rows and manifest."""
    label = job["output_label"]
    metric = job["selection_metric"] or job["tuning_metric"]
    labelled = fold_df.withColumn("dataset_label", F.lit(label))
    table = selection.select_candidates(labelled, metric, job["selection_rule"])
    best = selection.official_candidate(table)
    matches = [
        i
        for i, c in enumerate(candidates)
        if (c.comparison_name, c.model_type, c.p) == (best.comparison_name, best.model_type, best.p)
    ]
    if len(matches) != 1:
        raise ValueError(f"{len(matches)} candidates are marked as selected, one is needed")
    at = matches[0]
    # Saved parameters are the displayed ones, at three digits; the held-out refits use those.
    shown = parse_params(format_params(final_params[at]))
    folder = files.join(root, "selected_models")
    paths = {
        "final": files.join(folder, label + SELECTED_FINAL),
        "summary": files.join(folder, label + SELECTED_SUMMARY),
        "manifest": files.join(folder, label + SELECTED_MANIFEST),
        "oof": files.join(folder, label + SELECTED_OOF) if job["write_selected_oof_diagnostics"] else None,
    }
    source = inference_paths[(best.comparison_name, best.model_type)]
    sinks.write_csv(_read_inference(spark, source), paths["final"])
    if paths["oof"]:
        by_fold = {k: parse_params(format_params(p)) for k, p in chosen[at].items()}
        rows = oof_table(job, label, candidates[at], candidates, folds, outer, by_fold)
        sinks.write_csv(rows, paths["oof"])
    picked = col("official_selected")
    facts = {
        "final_model_params": format_params(shown),
        "selected_final_inference_path": paths["final"],
        "selected_oof_predictions_path": paths["oof"] or "",
        "evidence_type": oof.EVIDENCE,
    }
    summary = selection.select_model_files(table)
    for name, value in facts.items():
        summary = summary.withColumn(name, F.when(picked, F.lit(value)).otherwise(F.lit("")))
    ordered = round_floats(summary).orderBy("comparison_name", "model_type", "p")
    sinks.write_csv(ordered, paths["summary"], small=True)
    record = best.record
    manifest = {
        "dataset_label": label,
        "model_type": best.model_type,
        "comparison_name": best.comparison_name,
        "p": best.p,
        "selection": {
            "metric": metric,
            "rule": job["selection_rule"],
            **{f"outer_cv_metric_{s}": float(record[f"{metric}_{s}"]) for s in ("mean", "std", "sem")},
            "n_outer_folds": int(record["n_outer_folds"]),
            **{n: float(record[n]) for n in ("best_metric_mean", "best_metric_sem", "one_se_threshold")},
            "one_se_eligible_count": int(record["one_se_eligible_count"]),
            "best_candidate": {
                "comparison_name": record["best_comparison_name"],
                "model_type": record["best_model_type"],
                "p": int(record["best_p"]),
            },
        },
        "final_model_params": shown,
        "artifacts": {
            "selected_model_summary": paths["summary"],
            "selected_final_inference": paths["final"],
            "selected_oof_predictions": paths["oof"],
        },
        "evidence_type": oof.EVIDENCE,
        "diagnostic_caveat": CAVEAT,
    }
    sinks.write_yaml(spark, manifest, paths["manifest"])
    return {"selected": best, "table": table, "final_params": shown, "paths": paths}


def compare_fixed(
    candidate: Candidate, folds: DataFrame, options: Mapping[str, Any], params: Mapping[str, Any]
) -> tuple[DataFrame, dict[str, float]]:
    """Evaluate one parameter set on given folds; return fold metrics and their means."""
    rows = candidate.training.drop(splits.ROW).join(folds, KEYS)
    tests = sorted(r[0] for r in rows.where(col(OUTER).isNotNull()).select(OUTER).distinct().collect())
    parts = []
    for k in tests:
        held = col(OUTER).eqNullSafe(F.lit(k))
        model = models.fit(
            rows.where(~held), candidate.model_type, candidate.features, registry.LABEL, params, candidate.standardize
        )
        parts.append(models.predict(model, rows.where(held), "prediction").select(*KEYS, OUTER, registry.LABEL, "prediction"))
    table = regression_metrics(assemble.pool(parts), [OUTER], registry.LABEL, "prediction", tie_break=KEYS, **options)
    names = metric_names(options)
    means = table.agg(*[F.avg(m).alias(m) for m in names]).first()
    return table, {m: math.nan if means[m] is None else means[m] for m in names}


