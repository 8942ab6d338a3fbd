"""Quantile bins of first-come ranks, and equal-width bins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaysift.functions.numeric import col, number
from assaysift.functions.ordering import choose, null_safe_join, quantiles, row_positions
from assaysift.session import reliable_checkpoint


def quantile_edges(bins: int) -> list[float]:
    """Return the interior and outer probabilities of ``bins`` equal-frequency bins, as evaluated in floating point."""
    return [float(t * 100 / 100) for t in np.linspace(0, 1, bins + 1)]


def bin_of_position(position: Column, total: Column, bins: int) -> Column:
    """Return the 1-based bin of a position among ``total`` distinct ranks cut at ``bins`` quantiles."""
    crossed = F.lit(0)
    for t in quantile_edges(bins)[:-1]:
        crossed = crossed + F.when(F.lit(1.0) + (total - 1) * F.lit(t) < position, 1).otherwise(0)
    return F.greatest(F.lit(1), crossed).cast("int")


def quantile_bins(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    tie_break: Sequence[str],
    out: str,
    max_bins: int = 10,
    limit_to_distinct: bool = False,
    strategy: str = "auto",
) -> DataFrame:
    """Add equal-frequency bins of the value's rank, ties in order of ``tie_break``; missing values bin to NULL.

    A group gets ``min(max_bins, rows)`` bins, and with ``limit_to_distinct`` no more than it has distinct values.
    """
    if max_bins < 1:
        raise ValueError("max_bins must be at least 1")
    strategy = choose(df, strategy)
    rows = df.withColumn("__v", number(value))
    names = [c for c in df.columns if c != out]
    if strategy == "window":
        # Missing values sort last and do not count, so one window pass over the rows suffices.
        parts = [col(g) for g in group] or [F.lit(0)]
        by_value = Window.partitionBy(*parts).orderBy(F.col("__v").asc_nulls_last())
        by_row = Window.partitionBy(*parts).orderBy(F.col("__v").asc_nulls_last(), *[col(t) for t in tie_break])
        whole = Window.partitionBy(*parts)
        placed = rows.withColumn("__pos", F.row_number().over(by_row)).withColumn("__n", F.count("__v").over(whole))
        if limit_to_distinct:
            ranked = placed.withColumn("__dense", F.when(F.col("__v").isNotNull(), F.dense_rank().over(by_value)))
            placed = ranked.withColumn("__distinct", F.max("__dense").over(whole))
        binned = placed.withColumn(out, F.when(F.col("__v").isNotNull(), _chosen_bin(max_bins, limit_to_distinct)))
        return binned.select(*[col(c) for c in names], out)
    rows = reliable_checkpoint(rows)
    order = [("__v", True), *[(t, True) for t in tie_break]]
    known = row_positions(rows.where("__v IS NOT NULL"), group, order, "__pos", "__n", strategy)
    if limit_to_distinct:
        values = rows.where("__v IS NOT NULL").select(*[col(g) for g in group], "__v").distinct()
        counts = values.groupBy(*[col(g) for g in group]).agg(F.count(F.lit(1)).alias("__distinct"))
        if group:
            known = null_safe_join(known, counts, group)
        else:
            one = counts.withColumn("__all", F.lit(0))
            known = known.withColumn("__all", F.lit(0)).join(F.broadcast(one), "__all").drop("__all")
    binned = known.withColumn(out, _chosen_bin(max_bins, limit_to_distinct)).select(*[col(c) for c in names], out)
    missing = rows.where("__v IS NULL").withColumn(out, F.lit(None).cast("int")).select(*binned.columns)
    return binned.unionByName(missing)


def _chosen_bin(max_bins: int, limit_to_distinct: bool) -> Column:
    """Return the bin of ``__pos`` among ``__n`` rows, with as many bins as the group supports."""
    allowed = F.least(F.lit(max_bins).cast("long"), F.col("__n"))
    if limit_to_distinct:
        allowed = F.least(allowed, F.col("__distinct"))
    chosen = F.lit(1)
    for bins in range(2, max_bins + 1):
        chosen = F.when(allowed == bins, bin_of_position(F.col("__pos"), F.col("__n"), bins)).otherwise(chosen)
    return chosen.cast("int")


def value_bins(df: DataFrame, value: str, out: str, max_bins: int = 10, strategy: str = "auto") -> DataFrame:
    """Add the 0-based bin between the value's own quantiles: equal values share a bin, equal edges are one edge.

    A bin holds its upper edge, the first one also the smallest value. Missing values bin to NULL.
    """
    if max_bins < 1:
        raise ValueError("max_bins must be at least 1")
    names = {f"__e{i}": p for i, p in enumerate(quantile_edges(max_bins))}
    edges = quantiles(df.select(number(value).alias("__v")), [], "__v", names, strategy)
    # One row, or none where no value is known.
    edges = edges.select(F.array_distinct(F.array(*names)).alias("__edges")).scalar()
    placed = df.withColumn("__v", number(value)).withColumn("__edges", edges)
    below = F.size(F.filter("__edges", lambda e: e < F.col("__v")))
    binned = placed.withColumn(out, F.when(F.col("__v").isNotNull(), F.greatest(F.lit(0), below - 1)).cast("int"))
    return binned.drop("__v", "__edges")


def width_bin(value: Column, lower: Column, upper: Column, bins: int) -> Column:
    """Return the 0-based equal-width bin; the upper edge belongs to the last bin."""
    return (F.least(F.width_bucket(value, lower, upper, F.lit(bins)), F.lit(bins)) - 1).cast("int")


def padded_limits(lower: Column, upper: Column) -> tuple[Column, Column]:
    """Widen a degenerate range by 4 percent, at least 0.05, on both sides."""
    padding = F.when(lower == upper, F.greatest(F.abs(lower) * 0.04, F.lit(0.05))).otherwise(F.lit(0.0))
    return lower - padding, upper + padding
