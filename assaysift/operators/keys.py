"""Key handling: required columns, uniqueness, complete-case joins, row universes and overlap flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaysift.functions.numeric import col


def require_columns(df: DataFrame, columns: Sequence[str], name: str, kind: str = "required") -> None:
    """Raise when columns are missing; looks at the schema only."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing {kind} column(s): {missing}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return the keys held by more than one row, with their counts."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], name: str) -> None:
    """Raise when keys repeat, naming ten offenders. One aggregation, combined on the map side."""
    offenders = [tuple(r)[:-1] for r in duplicate_keys(df, keys).limit(10).collect()]
    if offenders:
        raise ValueError(f"{name} contains duplicate {'/'.join(keys)} rows: {offenders}")


def require_none(df: DataFrame, keys: Sequence[str], message: str) -> None:
    """Raise when ``df`` has any row, naming ten of them."""
    rows = [tuple(r) for r in df.select(*[col(k) for k in keys]).limit(10).collect()]
    if rows:
        raise ValueError(f"{message}: {rows}")


def complete_case(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join tables on their keys. Missing values survive; missing keys do not."""
    if not frames:
        raise ValueError("frames must contain at least one table")
    return reduce(lambda a, b: a.join(b, list(keys), "inner"), frames)


def row_universe(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Return the rows of the first table whose keys occur in every table."""
    if not frames:
        raise ValueError("frames must contain at least one table")
    rest = [f.select(*[col(k) for k in keys]) for f in frames[1:]]
    return reduce(lambda a, b: a.join(b, list(keys), "left_semi"), rest, frames[0])


def flag_overlap(rows: DataFrame, labelled: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Add a 1/0 column after the keys: does the key occur among the labelled rows?"""
    known = labelled.select(*[col(k) for k in keys]).distinct().withColumn("__hit", F.lit(1))
    rest = [c for c in rows.columns if c not in {*keys, out}]
    joined = rows.join(known, list(keys), "left")
    return joined.select(
        *[col(k) for k in keys], F.coalesce("__hit", F.lit(0)).cast("int").alias(out), *[col(c) for c in rest]
    )


def merge_predictions(tables: Mapping[str, DataFrame], keys: Sequence[str], overlap: str) -> DataFrame:
    """Join per-candidate predictions into one wide table on the keys of the first.

    The tables are stacked and folded by key, so any number of candidates costs one shuffle instead of one join each.
    """
    if not tables:
        raise ValueError("tables must contain at least one table")
    stems = {
        "prediction": "pred",
        "pred_mean": "pred_mean",
        "pred_err": "pred_err",
        "prediction_mean": "pred_mean",
        "prediction_err": "pred_err",
    }
    wide: list[str] = []
    stacked = []
    for i, (name, table) in enumerate(tables.items()):
        values = {c: f"{stems[c]}_{name}" for c in table.columns if c in stems}
        wide.extend(values.values())
        stacked.append(
            table.select(
                *[col(k) for k in keys],
                *[col(c).cast("double").alias(v) for c, v in values.items()],
                *([col(overlap), F.lit(1).alias("__first")] if i == 0 else []),
            )
        )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    folded = rows.groupBy(*[col(k) for k in keys]).agg(
        F.max(col(overlap)).alias(overlap), F.max("__first").alias("__first"), *[F.max(col(c)).alias(c) for c in wide]
    )
    return folded.where("__first = 1").drop("__first")


def merge_diagnostics(frames: Sequence[DataFrame], keys: Sequence[str], columns: Sequence[str]) -> DataFrame | None:
    """Collect each diagnostic column from the first table that has it, over the union of keys."""
    parts = []
    seen: set[str] = set()
    for frame in frames:
        new = [c for c in columns if c in frame.columns and c not in seen]
        if not new:
            continue
        seen.update(new)
        # Of rows that repeat a key the one with the largest values counts, so the choice does not depend on row order.
        best = frame.groupBy(*[col(k) for k in keys]).agg(F.max(F.struct(*[col(c) for c in new])).alias("__best"))
        parts.append(best.select(*[col(k) for k in keys], "__best.*"))
    if not parts:
        return None
    return reduce(lambda a, b: a.join(b, list(keys), "outer"), parts)


def add_registry(rows: DataFrame, registry: DataFrame, key: str = "target", validate: bool = True) -> DataFrame:
    """Replace registry columns of a table by the registry's own; unknown keys are an error.

    The registry has one row per target, a handful by construction, so it is broadcast.
    """
    extra = [c for c in registry.columns if c != key]
    bare = rows.drop(*extra)
    if validate:
        unknown = bare.select(col(key)).join(F.broadcast(registry), key, "left_anti").distinct()
        require_none(unknown, [key], f"Unknown {key} value(s)")
    return bare.join(F.broadcast(registry), key, "left")
