"""Scans of the source tables, each with declared types and a required-column check."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaysift.functions.numeric import coerce_number, col
from assaysift.operators.keys import require_columns, require_unique
from assaysift.sources import files, registry

DATASET_COLUMNS = ("id", "target", "smiles", "label_pkd")
# Numeric columns of the text sources; every other column stays text.
NUMERIC_COLUMNS = {"prediction", "glidescore_sd", "label_pkd"}
FILE_ORDER = "file_order"


def read_table(spark: SparkSession, path: str, numeric: Iterable[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Scan one CSV file or directory, or its Parquet twin, typing only the named columns.

    The named table is read where it exists. Only where it does not, ``x.parquet`` stands in for ``x.csv``: it prunes
    columns and, when partitioned by target, whole partitions. Text is never turned into NULL by vocabulary (``na`` is a
    target class); numbers that do not parse are NULL, in either form.
    """
    twin = path.removesuffix(".csv") + ".parquet"
    found = next((p for p in (path, twin) if files.exists(spark, p)), None)
    if found is None:
        raise FileNotFoundError(f"no table at {path}")
    raw = spark.read.parquet(found) if found.endswith(".parquet") else spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    wanted = set(numeric)
    return raw.select(*[coerce_number(c).alias(c) if c in wanted else col(c) for c in raw.columns])


def project(df: DataFrame, required: Sequence[str], requested: Sequence[str] | None, name: str) -> DataFrame:
    """Keep the required columns, then the requested ones, each once."""
    require_columns(df, required, name)
    wanted = list(dict.fromkeys([*required, *(requested or [])]))
    require_columns(df, wanted, name, kind="requested")
    return df.select(*[col(c) for c in wanted])


def load_predictions(
    spark: SparkSession, data_dir: str, methods: Sequence[str] = registry.METHODS, validate: bool = True
) -> DataFrame:
    """Scan the method files into one long table (method, id, target, prediction, spread)."""
    parts = []
    for method in methods:
        if method not in registry.METHODS:
            raise ValueError(f"Unknown method: {method}")
        path = files.join(data_dir, "shared", "features", f"{method}_predictions.csv")
        table = read_table(spark, path)
        require_columns(table, ["id", "target", "prediction"], path)
        has_spread = registry.SPREAD_SOURCE_COLUMN in table.columns
        spread = col(registry.SPREAD_SOURCE_COLUMN) if has_spread else F.lit(None).cast("double")
        parts.append(table.select(F.lit(method).alias("method"), "id", "target", "prediction", spread.alias("spread")))
    predictions = reduce(DataFrame.unionByName, parts)
    if validate:
        require_unique(predictions, ["method", "id", "target"], "method predictions")
    return predictions


def spread_available(spark: SparkSession, data_dir: str) -> bool:
    """Return whether the spread method file carries its spread column."""
    path = files.join(data_dir, "shared", "features", f"{registry.SPREAD_METHOD}_predictions.csv")
    return registry.SPREAD_SOURCE_COLUMN in read_table(spark, path).columns


def load_library(
    spark: SparkSession, data_dir: str, target_class: str, with_source: bool = False, validate: bool = True
) -> DataFrame:
    """Scan the compound library of a class as (target_class, id, smiles[, source])."""
    path = files.join(data_dir, "shared", "datasets", registry.compound_file(target_class))
    table = read_table(spark, path)
    columns = ["id", "smiles", *(["source"] if with_source else [])]
    library = project(table, columns, None, path)
    if validate:
        require_unique(library, ["id"], path)
    return library.select(F.lit(target_class).alias("target_class"), *columns)


def load_target_library(spark: SparkSession, data_dir: str, target: str, validate: bool = True) -> DataFrame:
    """Return the library of a target's class with the target's metadata as constants."""
    spec = registry.get_target(target)
    library = load_library(spark, data_dir, spec.target_class, validate=validate)
    return library.select(
        "id",
        F.lit(target).alias("target"),
        "target_class",
        F.lit(spec.strain).cast("string").alias("strain"),
        "smiles",
    )


def load_assay(
    spark: SparkSession, data_dir: str, round_id: str, target: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Scan the labels of one target in one round, keeping the order of the file.

    The order is a struct of file, first byte of the block and row in the block, so it does not depend on how blocks are
    packed into tasks.
    """
    registry.get_target(target)
    path = files.join(data_dir, round_id, "assay_data", f"{target}.csv")
    raw = read_table(spark, path)
    table = project(raw, registry.ASSAY_COLUMNS, columns, path)
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")
    )
    return raw.select(*[col(c) for c in table.columns], place.alias(FILE_ORDER))


def load_class_assays(spark: SparkSession, data_dir: str, round_ids: Sequence[str], target_class: str) -> DataFrame:
    """Scan all label files of the rounds, keeping rows of the class or of its targets."""
    targets = registry.class_targets(target_class)
    parts = []
    for round_id in round_ids:
        folder = files.join(data_dir, round_id, "assay_data")
        if not files.is_dir(spark, folder):
            raise FileNotFoundError(f"Assay data folder not found: {folder}")
        for name in files.list_names(spark, folder):
            if not name.endswith(".csv"):
                continue
            path = files.join(folder, name)
            table = project(read_table(spark, path), registry.ASSAY_COLUMNS, None, path)
            parts.append(table.withColumn("round_id", F.coalesce("round_id", F.lit(round_id))))
    if not parts:
        kinds = ", ".join(f"{c} {'double' if c in NUMERIC_COLUMNS else 'string'}" for c in registry.ASSAY_COLUMNS)
        return spark.createDataFrame([], kinds)
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where((F.col("target_class") == target_class) | F.col("target").isin(targets))


def load_dataset(
    spark: SparkSession, data_dir: str, dataset_name: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Scan a saved dataset, checking its required columns."""
    path = files.join(data_dir, "shared", "datasets", dataset_name)
    return project(read_table(spark, path), DATASET_COLUMNS, columns, path)


def discover_rounds(spark: SparkSession, data_dir: str) -> list[str]:
    """List round folders that hold labels."""
    return [
        name
        for name in files.list_names(spark, data_dir)
        if name.startswith("round_") and files.is_dir(spark, files.join(data_dir, name, "assay_data"))
    ]


def resolve_rounds(spark: SparkSession, data_dir: str, round_ids: Sequence[str] | None) -> list[str]:
    """Return the requested rounds, or all of them, checking that their label folders exist."""
    rounds = discover_rounds(spark, data_dir) if round_ids is None else list(round_ids)
    if not rounds:
        raise ValueError("no assay round was named or found")
    missing = [r for r in rounds if not files.is_dir(spark, files.join(data_dir, r, "assay_data"))]
    if missing:
        raise FileNotFoundError(f"rounds without an assay folder: {missing}")
    return rounds
