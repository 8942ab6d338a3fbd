"""Dataset builders: saved training and inference tables, synthetic labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaysift.functions.numeric import col, round_half_even
from assaysift.operators import bins, features, keys, splits
from assaysift.plans.learner import build_datasets, feature_store
from assaysift.sources import files, registry, sinks, tables

# Rows, seed and template of the generated labels, and their noise.
GENERATED = {
    "fasn": ("furin", 300, 101),
    "na_ph1n1": ("pa_ph1n1", 400, 201),
    "na_h3n2": ("pa_h3n2", 422, 202),
    "na_h5n1": ("pa_h5n1", 414, 203),
}
STANDARDIZED = ("furin", "pa_ph1n1", "pa_h3n2", "pa_h5n1")
LEGACY_NAMES = {"compound_id": "id", "target_id": "target", "isomeric_smiles": "smiles"}
NOISE = 0.06


def build_dataset(
    spark: SparkSession,
    data_dir: str,
    round_id: str,
    targets: Sequence[str],
    requests: Sequence[Mapping],
    training_name: str | None = None,
    inference_name: str | None = None,
) -> tuple[DataFrame, DataFrame, str | None, str | None]:
    """Assemble pooled training and inference tables and save the ones that are named."""
    classes = {registry.get_target(t).target_class for t in targets}
    if len(classes) != 1:
        raise ValueError(f"targets must belong to one target class, got {sorted(classes)}")
    job = {"data_dir": data_dir, "train_round_id": round_id}
    need = {r[k] for r in requests for k in ("feature_set", "base_feature_set") if r.get(k)}
    store = feature_store(spark, job, classes.pop(), targets, need)
    training, inference = build_datasets(spark, job, requests, store, targets)
    training = training.drop(tables.FILE_ORDER)
    training_path = inference_path = None
    if training_name:
        training_path = sinks.write_csv(training, files.join(data_dir, round_id, "datasets", training_name))
    if inference_name:
        inference_path = sinks.write_csv(inference, files.join(data_dir, "shared", "datasets", inference_name))
    return training, inference, training_path, inference_path


def standardize_assay(spark: SparkSession, assays: DataFrame, library: DataFrame, target: str) -> DataFrame:
    """Rename legacy columns and rebuild label rows on the library; unknown ids are an error."""
    spec = registry.get_target(target)
    rows = assays.withColumnsRenamed({k: v for k, v in LEGACY_NAMES.items() if k in assays.columns})
    keys.require_columns(rows, ["id", "label_pkd"], f"assay table of {target}")
    joined = rows.select("id", "label_pkd").join(library.select("id", "smiles"), "id", "left")
    keys.require_none(joined.where(col("smiles").isNull()), ["id"], f"{target} has ids missing from the compound map")
    return _label_rows(joined, spec)


def _label_rows(rows: DataFrame, spec: registry.Target) -> DataFrame:
    return rows.select(
        "id",
        F.lit(spec.name).alias("target"),
        F.lit(spec.target_class).alias("target_class"),
        F.lit(spec.strain).cast("string").alias("strain"),
        "smiles",
        round_half_even(col("label_pkd"), 3).alias("label_pkd"),
        F.lit("synthetic").alias("label_source"),
        F.lit("round_synthetic").alias("round_id"),
    )


def hashed_normal(seed: int, *names: str):
    """Return a standard normal deviate per row, a function of the key alone."""
    text = splits.digest(seed, *names)
    u = F.greatest(splits.unit_interval(text), F.lit(1e-12))
    v = splits.unit_interval(F.substring(text, 9, 8))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def generate_assay(
    summary: DataFrame, library: DataFrame, templates: DataFrame, target: str, n_rows: int, seed: int
) -> DataFrame:
    """Sample compounds evenly over consensus deciles and give them the template labels in noisy consensus order."""
    binned = bins.value_bins(summary, "consensus_123_rank", "consensus_decile", 10)
    sampled = splits.stratified_sample(binned, "consensus_decile", ["id"], n_rows, seed)
    noisy = sampled.withColumn("__score", col("consensus_123_rank") + hashed_normal(seed, "id") * F.lit(NOISE))
    labelled = splits.map_by_rank(noisy, "__score", ["id"], templates, "label_pkd", ["id"], "label_pkd")
    rows = labelled.select("id", "label_pkd").join(library.select("id", "smiles"), "id", "left")
    return _label_rows(rows, registry.get_target(target))


def regenerate_assays(spark: SparkSession, data_dir: str, round_id: str, out_round_id: str) -> dict[str, str]:
    """Rebuild the synthetic label files into another round folder."""
    predictions = tables.load_predictions(spark, data_dir)
    paths, made = {}, {}
    for target in STANDARDIZED:
        source = tables.read_table(spark, files.join(data_dir, round_id, "assay_data", f"{target}.csv"))
        library = tables.load_library(spark, data_dir, registry.get_target(target).target_class)
        made[target] = standardize_assay(spark, source, library, target)
    for target, (template, n_rows, seed) in GENERATED.items():
        mine = predictions.where(col("target") == target)
        summary = features.rank_summary(features.method_table(mine, scores=False))
        library = tables.load_library(spark, data_dir, registry.get_target(target).target_class)
        made[target] = generate_assay(summary, library, made[template], target, n_rows, seed)
    for target, rows in made.items():
        path = files.join(data_dir, out_round_id, "assay_data", f"{target}.csv")
        paths[target] = sinks.write_csv(rows, path, small=True)
    return paths
