"""Folds, holdouts, bootstrap weights and stratified samples.

Rows are addressed by ``row_pos``, a 0-based position in a stated order. All randomness comes from digests keyed by seed and
position, by one rule at every size, so nothing is drawn on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import exp, factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.functions.numeric import col
from assaysift.functions.ordering import attach_by_key, null_safe_join, row_positions
from assaysift.operators.keys import require_columns

ROW = "row_pos"


def with_row_pos(df: DataFrame, order: Sequence[str], strategy: str = "auto") -> DataFrame:
    """Add the 0-based position of each row in the given order."""
    placed = row_positions(df, [], [(c, True) for c in order], ROW, strategy=strategy)
    return placed.withColumn(ROW, F.col(ROW) - 1)


def digest(seed: int, *keys: str) -> Column:
    """Return a keyed 128-bit hex digest of a row key, the same in any engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def unit_interval(text: Column) -> Column:
    """Map the first 32 bits of a hex digest to [0, 1)."""
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def wide_interval(text: Column) -> Column:
    """Map the first 52 bits of a hex digest to [0, 1)."""
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def fold_sizes(n: int, n_splits: int) -> list[int]:
    """Return fold sizes: the first ``n % n_splits`` folds are one row larger."""
    if not 2 <= n_splits <= n:
        raise ValueError(f"Cannot have number of splits {n_splits} with {n} rows")
    return [n // n_splits + (1 if i < n % n_splits else 0) for i in range(n_splits)]


def block_of(position: Column, total: Column, n_splits: int) -> Column:
    """Return the fold of a 0-based position when positions fill the folds block by block."""
    base = F.floor(total / F.lit(n_splits))
    larger = total % F.lit(n_splits)
    head = larger * (base + 1)
    return (
        F.when(position < head, F.floor(position / (base + 1)))
        .otherwise(larger + F.floor((position - head) / F.nullif(base, F.lit(0))))
        .cast("int")
    )


def digest_folds(
    df: DataFrame, keys: Sequence[str], n_splits: int, seed: int, out: str = "fold", strategy: str = "auto"
) -> DataFrame:
    """Assign equal-sized random folds by position in the order of the keyed digest; any number of rows."""
    placed = row_positions(
        df.withColumn("__d", digest(seed, *keys)), [], [("__d", True), *[(k, True) for k in keys]], "__p", "__n", strategy
    )
    return placed.withColumn(out, block_of(F.col("__p") - 1, F.col("__n"), n_splits)).drop("__d", "__p", "__n")


def random_kfold(
    df: DataFrame, n_splits: int = 5, shuffle: bool = True, random_state: int = 42, out: str = "fold"
) -> DataFrame:
    """Assign random folds to rows addressed by ``row_pos``."""
    n = df.count()
    fold_sizes(n, n_splits)
    if shuffle:
        return digest_folds(df, [ROW], n_splits, random_state, out)
    return df.withColumn(out, block_of(F.col(ROW), F.lit(n), n_splits))


def greedy_runs(sizes: Sequence[tuple[int, int]], n_splits: int) -> list[tuple[int, int, int, list[int]]]:
    """Return (size, start, end, folds) runs of greedy balancing over (group size, number of groups), largest size first.

    Each group goes to the currently lightest fold, the lowest number of several. Of the groups of one size, those at
    positions ``start`` to ``end - 1`` take ``folds`` in turn: while the loads of the lightest folds differ by less than
    one group and no other fold is reached, these folds repeat in the same order. So a size takes a few runs per fold,
    however many groups it has.
    """
    loads = [0] * n_splits
    runs = []
    for size, count in sorted(sizes, reverse=True):
        at = 0
        while at < count:
            order = sorted(range(n_splits), key=lambda f: (loads[f], f))
            turn = [f for f in order if loads[f] - loads[order[0]] < size]
            rounds = (count - at) // len(turn)
            if len(turn) < n_splits:
                rounds = min(rounds, (loads[order[len(turn)]] - max(loads[f] for f in turn)) // size)
            if rounds == 0:
                turn, rounds = turn[:1], 1
            for f in turn:
                loads[f] += size * rounds
            runs.append((size, at, at + rounds * len(turn), turn))
            at += rounds * len(turn)
    return runs


def group_kfold(df: DataFrame, group_column: str, n_splits: int = 5, out: str = "fold") -> DataFrame:
    """Assign folds so that no group is split, balancing fold sizes greedily, largest groups first.

    Groups of equal size go in descending order; missing keys are a group of their own, the last of its size. Only the
    number of groups of each size reaches the driver: n rows have at most sqrt(2 n) sizes.
    """
    require_columns(df, [group_column], "split table")
    sizes = df.groupBy(col(group_column).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    counted = [(r[0], r[1]) for r in sizes.groupBy("__n").count().collect()]
    n_groups = sum(c for _, c in counted)
    if n_groups < n_splits:
        raise ValueError(f"Cannot have number of splits {n_splits} greater than the number of groups {n_groups}")
    # Positions count upwards, missing keys first; the greedy order is downwards.
    placed = row_positions(sizes, ["__n"], [("__g", True)], "__p", "__m")
    runs = df.sparkSession.createDataFrame(greedy_runs(counted, n_splits), "__n long, __from long, __to long, __turn array<int>")
    turn = F.sort_array(F.collect_list(F.struct("__from", "__to", "__turn"))).alias("__runs")
    at = F.col("__m") - F.col("__p")
    run = F.filter("__runs", lambda r: (r["__from"] <= at) & (at < r["__to"]))[0]
    fold = F.get(run["__turn"], ((at - run["__from"]) % F.size(run["__turn"])).cast("int"))
    folds = placed.join(runs.groupBy("__n").agg(turn), "__n").select(col("__g").alias(group_column), "__n", fold.alias(out))
    return attach_by_key(df, folds, [group_column], "__n").drop("__n")


def random_holdout(
    df: DataFrame, validation_fraction: float = 0.2, random_state: int = 43, out: str = "is_test"
) -> DataFrame:
    """Flag a random ``ceil(n * fraction)`` rows as test."""
    if not 0 < validation_fraction < 1:
        raise ValueError("validation_fraction must be between 0 and 1")
    n = df.count()
    n_test = int(np.ceil(n * validation_fraction))
    placed = row_positions(df.withColumn("__d", digest(random_state, ROW)), [], [("__d", True), (ROW, True)], "__p")
    return placed.withColumn(out, F.col("__p") <= n_test).drop("__d", "__p")


def holdout_by_column(df: DataFrame, holdout_column: str, holdout_values: Sequence, out: str = "is_test") -> DataFrame:
    """Flag rows whose column takes one of the held-out values as test."""
    require_columns(df, [holdout_column], "split table")
    return df.withColumn(out, F.coalesce(col(holdout_column).isin(list(holdout_values)), F.lit(False)))


def make_folds(df: DataFrame, split_type: str, split_params: dict | None = None, out: str = "fold") -> DataFrame:
    """Assign test folds by split type. Rows that are in no test fold, as in a holdout, get NULL."""
    params = dict(split_params or {})
    if split_type == "random_kfold":
        return random_kfold(df, out=out, **params)
    if split_type == "group_kfold":
        return group_kfold(df, out=out, **params)
    if split_type == "random_holdout":
        flagged = random_holdout(df, out="__test", **params)
    elif split_type == "holdout_by_column":
        flagged = holdout_by_column(df, out="__test", **params)
    else:
        raise ValueError(f"Unsupported split_type: {split_type}")
    return flagged.withColumn(out, F.when(F.col("__test"), F.lit(0))).drop("__test")


# Distribution function of the unit Poisson law at 0, 1, 2, ...: as far as 52 bits can tell it from 1.
POISSON_CDF = tuple(accumulate(exp(-1) / factorial(k) for k in range(18)))


def poisson_weights(keys: Sequence[str], n_bootstrap: int, seed: int) -> Column:
    """Return an array with the row's multiplicity in each of ``n_bootstrap`` Poisson resamples."""
    weights = []
    for b in range(n_bootstrap):
        text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(b)), *[col(k).cast("string") for k in keys]))
        u = wide_interval(text)
        weights.append(sum((F.when(u >= F.lit(t), 1).otherwise(0) for t in POISSON_CDF), F.lit(0)))
    return F.array(*weights)


def bootstrap_weights(df: DataFrame, n_bootstrap: int, random_state: int = 42, out: str = "weights") -> DataFrame:
    """Add, per row, how often each of ``n_bootstrap`` resamples with replacement drew it."""
    if n_bootstrap <= 0:
        raise ValueError("n_bootstrap must be positive")
    n = df.count()
    if n == 0:
        raise ValueError("Cannot bootstrap an empty table")
    # Every row casts one draw per resample: a resample of n rows is n draws of positions, counted where they fall.
    drawn = df.select(ROW, F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))).alias("__b"))
    text = F.md5(F.concat_ws(":", F.lit(str(random_state)), col("__b").cast("string"), col(ROW).cast("string")))
    hits = drawn.select(F.floor(wide_interval(text) * n).cast("long").alias(ROW), "__b")
    counts = hits.groupBy(ROW).agg(*[F.count(F.when(F.col("__b") == b, 1)).cast("int").alias(f"__w{b}") for b in range(n_bootstrap)])
    table = counts.select(ROW, F.array(*[f"__w{b}" for b in range(n_bootstrap)]).alias(out))
    return df.join(table, ROW, "left").withColumn(out, F.coalesce(out, F.array_repeat(F.lit(0), n_bootstrap)))


def stratified_sample(
    df: DataFrame, stratum: str, keys: Sequence[str], n_rows: int, seed: int, strategy: str = "auto"
) -> DataFrame:
    """Sample ``n_rows`` rows near-equally over the strata, topping up at random where a stratum runs short.

    Strata in ascending order get ``n_rows // k`` rows, the first ``n_rows % k`` one more. Within a stratum rows enter
    in order of a keyed digest. The sample carries ``sample_pos``, a random order of its own.
    """
    strata = df.where(col(stratum).isNotNull()).select(col(stratum)).distinct()
    strata = row_positions(strata, [], [(stratum, True)], "__i", "__k", strategy=strategy)
    if strata.isEmpty():
        raise ValueError("stratified sampling needs at least one stratum")
    share = F.floor(F.lit(n_rows) / col("__k")) + F.when(col("__i") <= F.lit(n_rows) % col("__k"), 1).otherwise(0)
    quotas = strata.select(col(stratum), share.alias("__quota"))
    ordered = row_positions(
        df.withColumn("__d", digest(seed, *keys)),
        [stratum],
        [("__d", True), *[(k, True) for k in keys]],
        "__p",
        strategy=strategy,
    )
    ordered = null_safe_join(ordered, quotas, [stratum], "left")
    ordered = ordered.withColumn("__first", F.coalesce(F.col("__p") <= F.col("__quota"), F.lit(False)))
    # First the quotas, then everybody else in digest order, until n_rows are in.
    topped = row_positions(
        ordered.withColumn("__late", F.when(F.col("__first"), 0).otherwise(1)).withColumn("__d2", digest(seed + 1, *keys)),
        [],
        [("__late", True), ("__d2", True), *[(k, True) for k in keys]],
        "sample_pos",
        strategy=strategy,
    )
    return topped.where(F.col("sample_pos") <= n_rows).drop("__d", "__d2", "__p", "__quota", "__first", "__late")


def map_by_rank(
    scores: DataFrame,
    score: str,
    keys: Sequence[str],
    templates: DataFrame,
    template_value: str,
    template_keys: Sequence[str],
    out: str,
    strategy: str = "auto",
) -> DataFrame:
    """Give the i-th smallest score the i-th smallest template value; both tables must have the same number of rows."""
    counts = scores.count(), templates.count()
    if counts[0] != counts[1]:
        raise ValueError(f"{counts[0]} scores cannot take the values of {counts[1]} templates")
    left = row_positions(scores, [], [(score, True), *[(k, True) for k in keys]], "__i", strategy=strategy)
    right = row_positions(
        templates, [], [(template_value, True), *[(k, True) for k in template_keys]], "__i", strategy=strategy
    ).select("__i", col(template_value).alias(out))
    return left.join(right, "__i", "inner").drop("__i")


