"""Assay and scaffold coverage of compound libraries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.functions.labels import assay_group_label
from assaysift.functions.numeric import coerce_number, col
from assaysift.functions.ordering import attach_by_key
from assaysift.operators.keys import require_columns, require_none


def joined_set(values: Column) -> Column:
    """Aggregate: sorted distinct non-empty texts, joined by pipes."""
    text = values.cast("string")
    return F.array_join(F.array_sort(F.collect_set(F.when(text != "", text))), "|")


def assay_coverage(assays: DataFrame, key: Sequence[str] = ("id",), label: str = "label_pkd") -> DataFrame:
    """Aggregate label rows to one row per compound."""
    require_columns(assays, [*key, "target", "round_id", label], "assay table")
    value = coerce_number(label)
    return assays.groupBy(*[col(k) for k in key]).agg(
        F.lit(True).alias("assayed_any"),
        F.count(F.lit(1)).alias("n_assays"),
        # Targets of one compound are few, so the set doubles as the distinct count.
        F.size(F.collect_set("target")).cast("long").alias("n_assayed_targets"),
        joined_set(col("target")).alias("assayed_targets"),
        joined_set(col("round_id")).alias("assay_rounds"),
        F.avg(value).alias(f"{label}_mean"),
        F.max(value).alias(f"{label}_max"),
        F.min(value).alias(f"{label}_min"),
    )


def library_coverage(
    library: DataFrame, assays: DataFrame, key: Sequence[str] = ("id",), label: str = "label_pkd", validate: bool = True
) -> DataFrame:
    """Annotate every library compound with its assay coverage; labels of unknown compounds are an error."""
    require_columns(library, list(key), "library")
    if validate:
        unknown = assays.select(*[col(k) for k in key]).join(library, list(key), "left_anti").distinct()
        require_none(unknown, key, "Assay rows include ids absent from the compound library")
    joined = library.join(assay_coverage(assays, key, label), list(key), "left")
    filled = {
        "assayed_any": F.coalesce("assayed_any", F.lit(False)),
        "n_assays": F.coalesce("n_assays", F.lit(0)),
        "n_assayed_targets": F.coalesce("n_assayed_targets", F.lit(0)),
        "assayed_targets": F.coalesce("assayed_targets", F.lit("")),
        "assay_rounds": F.coalesce("assay_rounds", F.lit("")),
    }
    return joined.select(*[filled[c].alias(c) if c in filled else col(c) for c in joined.columns])


def scaffold_counts(
    compounds: DataFrame,
    group: Sequence[str],
    flag: str,
    library_count: str = "scaffold_library_count",
    flagged_count: str = "scaffold_assayed_count",
) -> DataFrame:
    """Count compounds and flagged compounds per scaffold."""
    return compounds.groupBy(*[col(g) for g in group]).agg(
        F.count(F.lit(1)).alias(library_count),
        F.sum(F.when(col(flag).cast("boolean"), 1).otherwise(0)).alias(flagged_count),
    )


def add_scaffold_counts(
    compounds: DataFrame,
    group: Sequence[str],
    flag: str,
    library_count: str = "scaffold_library_count",
    flagged_count: str = "scaffold_assayed_count",
) -> DataFrame:
    """Attach scaffold counts to each compound.

    Counts come from a map-side combined aggregation and return by a join that replicates the counts of heavy
    scaffolds, so a scaffold held by a third of the library stays spread over many tasks.
    """
    counts = scaffold_counts(compounds, group, flag, library_count, flagged_count)
    return attach_by_key(compounds, counts, group, library_count)


def coverage_bucket(fraction: Column) -> Column:
    """Name the assayed fraction of a scaffold."""
    return (
        F.when(fraction.isNull(), "unknown")
        .when(fraction <= 0, "0%")
        .when(fraction <= 0.10, "0-10%")
        .when(fraction <= 0.25, "10-25%")
        .when(fraction <= 0.50, "25-50%")
        .otherwise(">50%")
    )


def scaffold_annotations(compounds: DataFrame, labelled: DataFrame, scaffolds: DataFrame | None) -> DataFrame:
    """Return per compound its scaffold, counts, covered fraction and bucket; unknown without a scaffold table."""
    ids = compounds.select("id").distinct()
    if scaffolds is None:
        empty = {"murcko_scaffold": "string", "scaffold_type": "string"}
        out = ids.select("id", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
        for c in ("scaffold_library_count", "scaffold_assayed_count", "scaffold_coverage_fraction"):
            out = out.withColumn(c, F.lit(None).cast("double"))
        return out.withColumn("scaffold_coverage_group", F.lit("unknown"))
    known = labelled.select("id").distinct().withColumn("__flag", F.lit(1))
    rows = ids.join(scaffolds, "id").join(known, "id", "left").withColumn("__flag", F.coalesce("__flag", F.lit(0)))
    counted = add_scaffold_counts(rows, ["murcko_scaffold"], "__flag").drop("__flag")
    fraction = F.try_divide("scaffold_assayed_count", "scaffold_library_count")
    return counted.withColumn("scaffold_coverage_fraction", fraction).withColumn(
        "scaffold_coverage_group", coverage_bucket(col("scaffold_coverage_fraction"))
    )


def scaffold_coverage(compounds: DataFrame) -> DataFrame:
    """Summarise assay coverage per scaffold."""
    required = ["target_class", "murcko_scaffold", "scaffold_type", "assayed_any", "n_assays", "assayed_targets"]
    require_columns(compounds, required, "compound table")
    keys = ["target_class", "murcko_scaffold"]
    counts = compounds.groupBy(*keys).agg(
        joined_set(col("scaffold_type")).alias("scaffold_type"),
        F.count(F.lit(1)).alias("scaffold_library_count"),
        F.sum(F.when(col("assayed_any"), 1).otherwise(0)).alias("scaffold_assayed_count"),
        F.sum("n_assays").alias("n_assays"),
        # Sets of targets are small; distinct sets, then their members, combine on the map side.
        F.array_distinct(F.flatten(F.collect_set(F.split("assayed_targets", r"\|")))).alias("__targets"),
    )
    targets = F.array_join(F.array_sort(F.filter("__targets", lambda t: t != "")), "|")
    return counts.select(
        *keys,
        "scaffold_type",
        "scaffold_library_count",
        "scaffold_assayed_count",
        F.try_divide("scaffold_assayed_count", "scaffold_library_count").alias("scaffold_assayed_fraction"),
        "n_assays",
        targets.alias("assayed_targets"),
    )


def coverage_order(scaffolds: DataFrame) -> DataFrame:
    """Order scaffolds: most assayed, then most frequent, then by name."""
    return scaffolds.orderBy(F.desc("scaffold_assayed_count"), F.desc("scaffold_library_count"), "murcko_scaffold")


def top_scaffolds(scaffolds: DataFrame, n: int = 20) -> DataFrame:
    """Return the first ``n`` scaffolds; each task keeps only its own first ``n``."""
    return coverage_order(scaffolds).limit(n)


def class_summary(compounds: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """Return library size, assayed share and scaffold coverage per target class."""
    sizes = compounds.groupBy("target_class").agg(
        F.count(F.lit(1)).alias("library_size"),
        F.sum(F.when(col("assayed_any"), 1).otherwise(0)).alias("assayed_count"),
    )
    # The scaffold table is unique by (class, scaffold), so rows count scaffolds.
    covered = scaffolds.where(col("murcko_scaffold").isNotNull()).groupBy("target_class").agg(
        F.count(F.lit(1)).alias("scaffold_count"),
        F.sum(F.when(col("scaffold_assayed_count") > 0, 1).otherwise(0)).alias("assayed_scaffold_count"),
    )
    joined = sizes.join(covered, "target_class", "left")
    return joined.select(
        "target_class",
        "library_size",
        "assayed_count",
        F.try_divide("assayed_count", "library_size").alias("assay_fraction"),
        F.coalesce("scaffold_count", F.lit(0)).alias("scaffold_count"),
        F.coalesce("assayed_scaffold_count", F.lit(0)).alias("assayed_scaffold_count"),
        F.try_divide("assayed_scaffold_count", F.nullif("scaffold_count", F.lit(0))).alias("scaffold_coverage_fraction"),
    )


def assay_group(compounds: DataFrame, out: str = "assay_plot_group") -> DataFrame:
    """Name the plot group of a compound: unassayed, multi-target, or its single target."""
    single = F.when(col("assayed_targets") == "", F.lit("assayed")).otherwise(col("assayed_targets"))
    group = (
        F.when(~col("assayed_any"), F.lit("Unassayed"))
        .when(col("n_assayed_targets") > 1, F.lit("Multi-target"))
        .otherwise(assay_group_label(single))
    )
    return compounds.withColumn(out, group)
