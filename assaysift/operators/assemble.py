"""Training and inference tables, pooled over the targets of a class."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from assaysift.functions.numeric import col
from assaysift.sources import registry
from assaysift.sources.tables import FILE_ORDER

DROPPED_COLUMNS = ("label_source", "round_id")


def feature_columns(df: DataFrame, label: str = registry.LABEL, helpers: Sequence[str] = ()) -> list[str]:
    """Return the model inputs: every column that is neither metadata, label nor helper."""
    other = {*registry.METADATA_COLUMNS, registry.LABEL, label, FILE_ORDER, "row_pos", *helpers}
    return [c for c in df.columns if c not in other]


def order_columns(df: DataFrame, include_label: bool) -> DataFrame:
    """Order columns as metadata, label, features; drop bookkeeping columns."""
    metadata = [c for c in registry.METADATA_COLUMNS if c in df.columns]
    label = [registry.LABEL] if include_label and registry.LABEL in df.columns else []
    known = {*metadata, registry.LABEL if label else "", *DROPPED_COLUMNS}
    return df.select(*[col(c) for c in [*metadata, *label, *[c for c in df.columns if c not in known]]])


def training_table(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Join labels and features on (id, target)."""
    kept = [c for c in [*registry.METADATA_COLUMNS, registry.LABEL, FILE_ORDER] if c in labels.columns]
    return order_columns(labels.select(*kept).join(features, list(registry.KEYS), "inner"), include_label=True)


def inference_table(library: DataFrame, features: DataFrame) -> DataFrame:
    """Join the compound library of a target and features on (id, target)."""
    return order_columns(library.join(features, list(registry.KEYS), "inner"), include_label=False)


def pool(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack per-target tables by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
