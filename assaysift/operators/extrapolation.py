"""How far predictions reach beyond the labelled compounds: scaffold novelty, similarity and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaysift.functions.numeric import col
from assaysift.operators.coverage import add_scaffold_counts
from assaysift.operators.keys import add_registry, require_columns, require_none, require_unique
from assaysift.operators.similarity import nearest_labelled
from assaysift.sources import registry

# Fixed value: rows whose nearest labelled compound is less similar than this extrapolate.
SIMILARITY_THRESHOLD = 0.40


def scaffold_novelty(library_scaffolds: DataFrame, labelled: DataFrame) -> DataFrame:
    """Add scaffold counts, labelled share and the unseen flag to (target_class, id, scaffold) rows."""
    keys = ["target_class", "id"]
    require_columns(library_scaffolds, [*keys, "murcko_scaffold"], "scaffold table")
    known = labelled.select(*keys).distinct().withColumn("__flag", F.lit(1))
    rows = library_scaffolds.join(known, keys, "left").withColumn("__flag", F.coalesce("__flag", F.lit(0)))
    counted = add_scaffold_counts(
        rows, ["target_class", "murcko_scaffold"], "__flag", "scaffold_library_count", "scaffold_labeled_count"
    ).drop("__flag")
    share = F.try_divide("scaffold_labeled_count", "scaffold_library_count")
    return counted.withColumn("scaffold_labeled_fraction", share).withColumn(
        "unseen_scaffold_flag", (col("scaffold_labeled_count") == 0).cast("int")
    )


def flag_extrapolation(rows: DataFrame, labelled_classes: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Add the three flags, their disjunction and the reason text.

    ``labelled_classes`` holds one row per target class with labels, a handful by construction.
    """
    seen = labelled_classes.select("target_class").distinct().withColumn("__labelled", F.lit(1))
    marked = rows.join(F.broadcast(seen), "target_class", "left")
    marked = marked.withColumn("no_labeled_compounds_flag", F.when(col("__labelled").isNull(), 1).otherwise(0))
    low = F.coalesce(col("nearest_labeled_tanimoto") < F.lit(float(threshold)), F.lit(False)).cast("int")
    marked = marked.withColumn("low_similarity_flag", low).drop("__labelled")
    flags = ["unseen_scaffold_flag", "no_labeled_compounds_flag", "low_similarity_flag"]
    reasons = F.concat_ws(
        "|",
        F.when(col("unseen_scaffold_flag") == 1, "unseen_scaffold"),
        F.when(col("low_similarity_flag") == 1, "low_similarity"),
    )
    return marked.withColumn("extrapolation_flag", F.greatest(*[col(f) for f in flags])).withColumn(
        "extrapolation_reason",
        F.when(col("no_labeled_compounds_flag") == 1, "no_labeled_compounds").otherwise(reasons),
    )


def extrapolation_table(
    selected: DataFrame,
    library: DataFrame,
    scaffolds: DataFrame,
    labelled: DataFrame,
    sets: DataFrame,
    labelled_sets: DataFrame,
    registry_table: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    validate: bool = True,
) -> DataFrame:
    """Join selected predictions with library, scaffold and nearest-labelled facts.

    ``sets`` holds (target_class, id, bits) for the library, ``labelled_sets`` (target_class, id, target, bits).
    """
    rows = add_registry(selected, registry_table, validate=validate)
    require_columns(library, ["target_class", "id", "smiles", "source"], "compound library")
    keys = ["target_class", "id"]
    if validate:
        require_unique(library, keys, "Compound library")
    facts = library.select(*keys, "smiles", "source")
    kept = [c for c in rows.columns if c not in {"smiles", "source"}]
    joined = rows.select(*[col(c) for c in kept]).join(facts, keys, "left")
    if validate:
        missing = joined.where(col("smiles").isNull())
        require_none(missing, keys, "Selected inference rows are missing library metadata")
    joined = joined.join(scaffold_novelty(scaffolds, labelled), keys, "left")
    queries = rows.select(*keys, "target").join(sets, keys, "inner")
    near = nearest_labelled(queries, labelled_sets, "bits")
    joined = joined.join(near, ["target_class", "id", "target"], "left")
    flagged = flag_extrapolation(joined, labelled.select("target_class"), threshold)
    payload = [c for c in selected.columns if c not in {*registry.METADATA_COLUMNS, "source"}]
    return flagged.select(
        "id",
        "target",
        "target_class",
        "strain",
        "smiles",
        "source",
        *[col(c) for c in payload],
        "murcko_scaffold",
        "scaffold_type",
        "scaffold_library_count",
        "scaffold_labeled_count",
        "scaffold_labeled_fraction",
        "nearest_labeled_id",
        "nearest_labeled_target",
        "nearest_labeled_tanimoto",
        "nearest_labeled_same_target_id",
        "nearest_labeled_same_target_tanimoto",
        "unseen_scaffold_flag",
        "low_similarity_flag",
        "no_labeled_compounds_flag",
        "extrapolation_flag",
        "extrapolation_reason",
    )


def extrapolation_summary(rows: DataFrame, dataset_label: str) -> DataFrame:
    """Count flags per target class."""
    return rows.groupBy("target_class").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("extrapolation_flag").alias("n_extrapolation"),
        F.avg("extrapolation_flag").alias("extrapolation_fraction"),
        F.sum("unseen_scaffold_flag").alias("n_unseen_scaffold"),
        F.sum("low_similarity_flag").alias("n_low_similarity"),
        F.sum("no_labeled_compounds_flag").alias("n_no_labeled_compounds"),
    ).select(F.lit(dataset_label).alias("dataset_label"), "*")
