"""Regression and hit-ranking metrics per group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.functions.numeric import col, finite, number
from assaysift.functions.ordering import attach_by_key, choose, pair_ranks, prefix_totals, row_positions
from assaysift.session import reliable_checkpoint

MAXIMISED = ("spearman", "r2")
#: Metrics of errors and ranks alone, which need no order of predictions.
BY_ERROR = ("rmse", "mae", "r2", "spearman")


def higher_is_better(metric: str) -> bool:
    """Return whether larger values of a metric are better."""
    return metric in MAXIMISED or metric.startswith(("ef_", "precision_at_"))


def enrichment_name(fraction: float) -> str:
    """Name an enrichment metric after its top fraction: ``ef_1pct``, ``ef_2p5pct``."""
    percent = fraction * 100.0
    text = str(int(percent)) if float(percent).is_integer() else str(percent).replace(".", "p")
    return f"ef_{text}pct"


def hit(label: Column, threshold: float) -> Column:
    """Return 1 where a label reaches the threshold, else 0, also for a missing or NaN label."""
    return F.when((label >= F.lit(float(threshold))) & ~F.isnan(label.cast("double")), 1).otherwise(0)


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation, NULL when fewer than two rows or a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    varied = (F.count(x) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), spread))


def with_pair_ranks(
    df: DataFrame, group: Sequence[str], x: str, y: str, x_rank: str, y_rank: str, strategy: str = "auto"
) -> DataFrame:
    """Keep rows where both values are finite and add their average ranks within the group."""
    strategy = choose(df, strategy)
    pairs = df.withColumn("__x", finite(x)).withColumn("__y", finite(y)).where("__x IS NOT NULL AND __y IS NOT NULL")
    return pair_ranks(pairs, group, {"__x": x_rank, "__y": y_rank}, strategy)


def correlations(df: DataFrame, group: Sequence[str], x: str, y: str, strategy: str = "auto") -> DataFrame:
    """Return n, spearman and pearson per group over pairwise complete rows.

    Equal pairs collapse to one row with their number before anything is ordered, and ranks belong to values: those of a side
    are found on its distinct values alone, then meet the distinct pairs.
    """
    if choose(df, strategy) == "window":
        ranked = with_pair_ranks(df, group, x, y, "__rx", "__ry", strategy)
        return ranked.groupBy(*[col(g) for g in group]).agg(
            F.count(F.lit(1)).alias("n"),
            safe_corr(F.col("__rx"), F.col("__ry")).alias("spearman"),
            safe_corr(F.col("__x"), F.col("__y")).alias("pearson"),
        )
    keys = [col(g) for g in group]
    sides = {"__x": "__rx", "__y": "__ry"}
    complete = df.select(*keys, finite(x).alias("__x"), finite(y).alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
    pairs = reliable_checkpoint(complete.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("__n")))
    ranked = pairs
    for side, rank in sides.items():
        values = pairs.groupBy(*keys, side).agg(F.sum("__n").alias("__w"), F.count(F.lit(1)).alias("__pairs"))
        totals = prefix_totals(values, group, [side], {"__w": F.col("__w"), "__sum": F.col("__w") * F.col(side), "__pairs": F.col("__pairs")})
        # Both centred: ranks run from half the group's rows below zero to half above it.
        centred = [
            (F.col("__w_before") + (F.col("__w") - F.col("__w_total")) / F.lit(2.0)).alias(rank),
            (F.col(side) - F.col("__sum_total") / F.col("__w_total")).alias(f"{side}_off"),
        ]
        lookup = reliable_checkpoint(totals.select(*keys, side, *centred, "__pairs"))
        ranked = attach_by_key(ranked, lookup, [*group, side], "__pairs").drop("__pairs")
    pair_sum = {
        f"{a}{b}": F.sum(F.col(a) * F.col(b) * F.col("__n"))
        for a, b in (("__rx", "__rx"), ("__ry", "__ry"), ("__rx", "__ry"), ("__x_off", "__x_off"), ("__y_off", "__y_off"), ("__x_off", "__y_off"))
    }
    varied = (pair_sum["__rx__rx"] > 0) & (pair_sum["__ry__ry"] > 0)

    def correlation(a: str, b: str) -> Column:
        spread = F.sqrt(pair_sum[a + a]) * F.sqrt(pair_sum[b + b])
        return F.when(varied, F.try_divide(pair_sum[a + b], spread))

    return ranked.groupBy(*keys).agg(
        F.sum("__n").alias("n"), correlation("__rx", "__ry").alias("spearman"), correlation("__x_off", "__y_off").alias("pearson")
    )


def top_k(total: Column, fraction: float) -> Column:
    """Return how many rows make up a top fraction: at least one, rounded up."""
    if not 0 < fraction <= 1:
        raise ValueError("top_fraction must be between 0 and 1")
    return F.greatest(F.lit(1).cast("long"), F.ceil(total.cast("double") * F.lit(float(fraction))))


def regression_metrics(
    df: DataFrame,
    group: Sequence[str],
    label: str,
    prediction: str,
    hit_threshold: float | None = None,
    top_fractions: Sequence[float] = (),
    top_counts: Sequence[int] = (),
    tie_break: Sequence[str] = (),
    strategy: str = "auto",
    only: str | None = None,
) -> DataFrame:
    """Return rmse, mae, r2, spearman and, with a hit threshold, enrichment and precision metrics per group.

    Rows tied on the prediction enter the top of the ranking in order of ``tie_break``. With ``only``, the name of one
    metric, no ordering is made that this metric does not need, and the others that would need it are missing.
    """
    if any(n <= 0 for n in top_counts):
        raise ValueError("n must be positive")
    strategy = choose(df, strategy)
    keys = [col(g) for g in group]
    wants_ranks = only in (None, "spearman")
    if wants_ranks:
        ranked = with_pair_ranks(df, group, label, prediction, "__ry", "__rp", strategy)
    else:
        ranked = df.withColumn("__x", finite(label)).withColumn("__y", finite(prediction)).where("__x IS NOT NULL AND __y IS NOT NULL")
    ranked = ranked.withColumnRenamed("__x", "__label").withColumnRenamed("__y", "__pred")
    error = F.col("__label") - F.col("__pred")
    aggregates = [
        F.count(F.lit(1)).alias("__n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.sum(error * error).alias("__sse"),
        F.var_pop(F.col("__label")).alias("__var"),
        (F.min("__label") == F.max("__label")).alias("__flat"),
        (safe_corr(F.col("__ry"), F.col("__rp")) if wants_ranks else F.lit(None).cast("double")).alias("spearman"),
    ]
    wants_hits = hit_threshold is not None and (top_fractions or top_counts) and only not in BY_ERROR
    if wants_hits:
        ranked = row_positions(
            ranked.withColumn("__hit", hit(F.col("__label"), hit_threshold)),
            group,
            [("__pred", False), *[(t, True) for t in tie_break]],
            "__pos",
            "__total",
            strategy,
        )
        aggregates.append(F.sum("__hit").alias("__hits"))
        for fraction in top_fractions:
            inside = F.col("__pos") <= top_k(F.col("__total"), fraction)
            aggregates.append(F.sum(F.when(inside, F.col("__hit")).otherwise(0)).alias(f"__top_{enrichment_name(fraction)}"))
        for n in top_counts:
            inside = F.col("__pos") <= F.lit(int(n))
            aggregates.append(F.sum(F.when(inside, F.col("__hit")).otherwise(0)).alias(f"__top_{int(n)}"))
    out = ranked.groupBy(*keys).agg(*aggregates)
    sst = F.col("__var") * F.col("__n")
    flat = F.when(F.col("__sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(F.col("__n") < 2, F.lit(None)).when(F.col("__flat"), flat)
    columns = [
        "rmse",
        "mae",
        r2.otherwise(1 - F.try_divide(F.col("__sse"), sst)).alias("r2"),
        "spearman",
    ]
    if wants_hits:
        for fraction in top_fractions:
            name = enrichment_name(fraction)
            observed = F.col(f"__top_{name}") / top_k(F.col("__n"), fraction)
            baseline = F.col("__hits") / F.col("__n")
            columns.append(F.try_divide(observed, F.nullif(baseline, F.lit(0.0))).alias(name))
        for n in top_counts:
            taken = F.least(F.lit(int(n)).cast("long"), F.col("__n"))
            columns.append((F.col(f"__top_{int(n)}") / taken).alias(f"precision_at_{int(n)}"))
    return out.select(*keys, F.col("__n").alias("n_test"), *columns)


def python_round(value: float | None, digits: int = 4) -> float | None:
    """Round a driver-side metric decimally; missing stays missing."""
    return None if value is None or math.isnan(value) else round(float(value), digits)


def mean_over_folds(folds: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Average metrics over folds, skipping missing values."""
    return folds.groupBy(*[col(g) for g in group]).agg(*[F.avg(number(m)).alias(m) for m in metrics])

