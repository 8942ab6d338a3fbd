"""Diagnostics over learner outputs: evaluation tables, selected-model behaviour, chemical space, extrapolation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaysift.functions.labels import target_set_label
from assaysift.functions.numeric import col
from assaysift.operators import chem, coverage, extrapolation, oof, pairs, selection, trials
from assaysift.session import reliable_checkpoint
from assaysift.sources import files, registry, results, sinks, tables

# Output columns.
SPACE_COLUMNS = (
    "target_class",
    "id",
    "smiles",
    "source",
    "assayed_any",
    "n_assays",
    "n_assayed_targets",
    "assayed_targets",
    "assay_rounds",
    "label_pkd_mean",
    "label_pkd_max",
    "label_pkd_min",
    "murcko_scaffold",
    "scaffold_type",
    "scaffold_library_count",
    "scaffold_assayed_count",
    "umap_x",
    "umap_y",
    "assay_plot_group",
)


def evaluation_diagnostics(
    spark: SparkSession,
    results_dir: str,
    round_id: str,
    datasets: Sequence[str] | None = None,
    metric: str = "spearman",
) -> dict[str, str]:
    """Write fold winners, family summaries, best trials and score landscapes of a round."""
    read = results.evaluation_tables(spark, results.evaluation_runs(spark, results_dir, round_id, datasets))
    out = files.join(results_dir, round_id, "visualizations", "evaluation")
    slug = metric.replace(" ", "_").replace("/", "_")
    paths = {}

    def write(name: str, df: DataFrame) -> None:
        paths[name] = sinks.write_csv(df, files.join(out, f"{name}.csv"), small=True)

    folds, trace = read["fold_metrics"], read["trace"]
    write("model_comparison_tuning_trace", trace)
    write("model_family_feature_summary", selection.family_summary(folds, metric))
    write("fold_winner_stability", selection.fold_winners(folds, metric))
    best = selection.attach_outer_metric(trials.best_trials(trace, metric), folds, metric)
    best = trials.labelled_trials(best)
    inner = reliable_checkpoint(trials.labelled_trials(trials.outer_trials(trace, metric)))
    landscape = reliable_checkpoint(trials.score_landscape(inner))
    families = [r[0] for r in inner.select("model_type").distinct().collect()]
    for model in sorted(set(families) & set(trials.LANDSCAPE)):
        mine = col("model_type") == model
        write(f"{model}_selected_tuning_outer_{slug}_trials", trials.present_columns(best.where(mine)))
        write(f"{model}_inner_cv_tuning_trials", trials.present_columns(inner.where(mine)))
        write(f"{model}_inner_cv_tuning_score_landscape", trials.present_columns(landscape.where(mine)))
    return paths


def selected_model_diagnostics(
    spark: SparkSession,
    results_dir: str,
    round_id: str,
    datasets: Sequence[str] | None = None,
    disagreement: str = oof.DEFAULT_DISAGREEMENT,
) -> dict[str, str]:
    """Write held-out accuracy, disagreement and cross-strain tables of a round."""
    runs = results.selected_runs(spark, results_dir, round_id, datasets)
    rows = reliable_checkpoint(oof.prepare_oof(results.selected_oof(spark, runs), disagreement))
    final = results.selected_final(spark, runs)
    out = files.join(results_dir, round_id, "visualizations", "selected_models")
    paths = {}

    def write(name: str, df: DataFrame, small: bool = False) -> None:
        paths[name] = sinks.write_csv(df, files.join(out, f"selected_model_{name}.csv"), small)

    pair_rows = reliable_checkpoint(pairs.target_pairs(rows))
    triplets = reliable_checkpoint(pairs.oof_triplets(rows))
    final_rows = reliable_checkpoint(pairs.final_triplets(final))
    write("oof_predictions", rows)
    write("prediction_summary", oof.prediction_summary(rows), small=True)
    write("disagreement_summary", oof.disagreement_summary(rows, disagreement), small=True)
    write("cross_strain_oof_pairs", pair_rows)
    write("cross_strain_oof_triplets", triplets)
    write("cross_strain_final_triplets", final_rows)
    write("cross_strain_summary", pairs.pair_summary(rows, pair_rows, triplets, final_rows), small=True)
    return paths


def chemical_space(
    spark: SparkSession, data_dir: str, round_ids: Sequence[str], target_class: str, embed: bool = True
) -> DataFrame:
    """Return the library of a class with assay coverage, scaffolds and, optionally, planar coordinates."""
    library = tables.load_library(spark, data_dir, target_class, with_source=True)
    assays = tables.load_class_assays(spark, data_dir, round_ids, target_class)
    covered = coverage.library_coverage(library, assays)
    scaffolds = chem.scaffolds(library.select("id", "smiles"))
    with_scaffold = reliable_checkpoint(covered.join(scaffolds, "id", "left"))
    counted = coverage.add_scaffold_counts(with_scaffold, ["murcko_scaffold"], "assayed_any")
    if embed:
        plane = chem.planar_embedding(chem.fingerprints(library))
        counted = counted.join(plane, "id", "left")
    grouped = coverage.assay_group(counted)
    return grouped.select(*[c for c in SPACE_COLUMNS if c in grouped.columns])


def chemical_space_diagnostics(
    spark: SparkSession,
    data_dir: str,
    results_dir: str,
    round_ids: Sequence[str] | None = None,
    target_classes: Sequence[str] | None = None,
    top_n: int = 20,
    embed: bool = True,
) -> dict[str, str]:
    """Write chemical-space, scaffold coverage and class summary tables."""
    rounds = tables.resolve_rounds(spark, data_dir, round_ids)
    classes = list(target_classes or registry.TARGET_CLASSES)
    unknown = sorted(set(classes) - set(registry.TARGET_CLASSES))
    if unknown:
        raise ValueError(f"Unknown target_class value(s): {unknown}")
    folder = rounds[0] if len(rounds) == 1 else "all_rounds"
    out = files.join(results_dir, folder, "visualizations", "chemical_space")
    paths, summaries = {}, []
    for target_class in classes:
        compounds = reliable_checkpoint(chemical_space(spark, data_dir, rounds, target_class, embed))
        scaffolds = coverage.scaffold_coverage(compounds)
        shown = scaffolds.withColumn("display_assayed_targets", target_set_label(col("assayed_targets")))
        tables_ = {
            f"chemical_space_{target_class}": (compounds, False),
            f"scaffold_coverage_{target_class}": (coverage.coverage_order(scaffolds), False),
            f"scaffold_coverage_top_{target_class}": (coverage.top_scaffolds(shown, top_n), True),
        }
        for name, (df, small) in tables_.items():
            paths[name] = sinks.write_csv(df, files.join(out, f"{name}.csv"), small)
        summaries.append(coverage.class_summary(compounds, scaffolds))
    summary = reduce(DataFrame.unionByName, summaries)
    paths["chemical_space_summary"] = sinks.write_csv(summary, files.join(out, "chemical_space_summary.csv"), small=True)
    return paths


def extrapolation_diagnostics(
    spark: SparkSession,
    data_dir: str,
    results_dir: str,
    round_id: str,
    assay_round_ids: Sequence[str] | None = None,
    datasets: Sequence[str] | None = None,
    threshold: float = extrapolation.SIMILARITY_THRESHOLD,
    radius: int = chem.RADIUS,
    bits: int = chem.BITS,
) -> dict[str, Any]:
    """Write, per dataset, how far its selected predictions reach beyond labelled compounds, and a summary."""
    labels = list(datasets or results.final_labels(spark, results_dir, round_id))
    out = files.join(results_dir, round_id, "buckets")
    registry_rows = registry.registry_table(spark)
    paths, summaries = {}, []
    for label in labels:
        selected = results.final_inference(spark, results_dir, round_id, label)
        targets = [r[0] for r in selected.select("target").distinct().collect()]
        classes = sorted({registry.get_target(t).target_class for t in targets})
        stacked = {
            "library": [tables.load_library(spark, data_dir, c, with_source=True) for c in classes],
            "labelled": [tables.load_class_assays(spark, data_dir, assay_round_ids or [round_id], c) for c in classes],
        }
        library, labelled = (reduce(lambda a, b: a.unionByName(b), stacked[k]) for k in ("library", "labelled"))
        scaffolds, sets, labelled_sets = [], [], []
        for c in classes:
            compounds = library.where(col("target_class") == c)
            mark = F.lit(c).alias("target_class")
            scaffolds.append(chem.scaffolds(compounds).select(mark, "*"))
            sets.append(chem.fingerprints(compounds, radius=radius, bits=bits).select(mark, "id", "bits"))
            known = labelled.where(col("target_class") == c).select("id", "target", "smiles").distinct()
            prints = chem.fingerprints(known, radius=radius, bits=bits).select("id", "bits")
            labelled_sets.append(known.join(prints, "id").select(mark, "id", "target", "bits"))
        union = {k: reduce(lambda a, b: a.unionByName(b), v) for k, v in
                 {"scaffolds": scaffolds, "sets": sets, "labelled_sets": labelled_sets}.items()}
        rows = reliable_checkpoint(
            extrapolation.extrapolation_table(
                selected, library, union["scaffolds"], labelled, union["sets"], union["labelled_sets"], registry_rows, threshold
            )
        )
        paths[label] = sinks.write_csv(rows, files.join(out, f"{label}_extrapolation_artifact.csv"))
        summaries.append(extrapolation.extrapolation_summary(rows, label))
    summary = reduce(DataFrame.unionByName, summaries)
    paths["extrapolation_summary"] = sinks.write_csv(summary, files.join(out, "extrapolation_summary.csv"), small=True)
    return paths
