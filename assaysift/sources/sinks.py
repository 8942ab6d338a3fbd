"""Sinks: CSV tables, YAML documents."""

from __future__ import annotations

from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from assaysift.sources import files


def write_csv(df: DataFrame, path: str, small: bool = False) -> str:
    """Write a table as a CSV directory; ``small`` tables (metrics, summaries) land in one part file."""
    out = df.coalesce(1) if small else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a table as Parquet, optionally partitioned."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_yaml(spark: SparkSession, document: dict[str, Any], path: str) -> str:
    """Write a small YAML document, keeping key order."""
    files.write_text(spark, path, yaml.safe_dump(document, sort_keys=False))
    return path
