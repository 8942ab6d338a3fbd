"""Ridge regression from distributed sufficient statistics.

One pass over the rows yields the weighted moments of (1, features, label) per group and bootstrap replicate. Everything
else, such as centring, standardising, every regularisation strength and every train split of a cross-validation (total
minus held-out), is algebra on matrices of a few dozen columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.functions.numeric import col, number

# Up to this many features the moments are plain SQL sums; beyond it, blocks of rows go through a matrix product.
SQL_FEATURES = 8


@dataclass(frozen=True)
class Moments:
    """Weighted second moments of z = (1, x - shift, y), with the range of y where it is known."""

    matrix: np.ndarray
    shift: np.ndarray
    n_rows: int
    y_range: tuple[float, float] | None = None

    @property
    def weight(self) -> float:
        return float(self.matrix[0, 0])

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.matrix - other.matrix, self.shift, self.n_rows - other.n_rows)


@dataclass(frozen=True)
class RidgeModel:
    """Linear model on raw feature columns."""

    features: tuple[str, ...]
    coefficients: np.ndarray
    intercept: float

    def column(self) -> Column:
        """Return the prediction as an expression; NULL where a feature is missing."""
        out = F.lit(float(self.intercept))
        for name, weight in zip(self.features, self.coefficients, strict=True):
            out = out + number(name) * F.lit(float(weight))
        return out


def _upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def moments(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    group: Sequence[str] = (),
    weights: str | None = None,
    n_weights: int = 1,
) -> dict[tuple, list[Moments]]:
    """Return, per group, the moments of each bootstrap replicate (one when ``weights`` is None).

    Only the moment matrices, of (features + 2) squared numbers, reach the driver. Groups are folds, a handful.
    """
    keys = [col(g) for g in group]
    used = [number(f).alias(f"x{i}") for i, f in enumerate(features)]
    rows = df.select(
        *keys,
        *used,
        number(label).alias("y"),
        (col(weights) if weights else F.array(F.lit(1))).cast("array<double>").alias("w"),
    )
    complete = F.col("y").isNotNull()
    for i in range(len(features)):
        complete = complete & F.col(f"x{i}").isNotNull()
    means = rows.agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(features))],
        F.count(F.when(~complete, 1)).alias("incomplete"),
    ).first()
    if means["incomplete"]:
        raise ValueError("Linear models need complete rows: a feature or label is missing.")
    shift = np.array([means[f"m{i}"] or 0.0 for i in range(len(features))])
    for i in range(len(features)):
        rows = rows.withColumn(f"x{i}", F.col(f"x{i}") - F.lit(float(shift[i])))
    size = len(features) + 2
    if len(features) <= SQL_FEATURES:
        table = _sql_moments(rows, keys, size, n_weights)
    else:
        table = _block_moments(rows, group, size, n_weights)
    out: dict[tuple, list[Moments]] = {}
    for row in table.collect():
        key = tuple(row[g] for g in group)
        matrix = np.zeros((size, size))
        for (i, j), value in zip(_upper(size), row["values"], strict=True):
            matrix[i, j] = matrix[j, i] = value
        out.setdefault(key, [None] * n_weights)[row["replicate"]] = Moments(
            matrix, shift, int(row["n_rows"]), (row["y_low"], row["y_high"])
        )
    return out


def _sql_moments(rows: DataFrame, keys: Sequence[Column], size: int, n_weights: int) -> DataFrame:
    """Sum products with built-in aggregates, combined on the map side."""
    z = [F.lit(1.0), *[F.col(f"x{i}") for i in range(size - 2)], F.col("y")]
    long = rows.select(*rows.columns, F.posexplode("w").alias("replicate", "wt")) if n_weights > 1 else rows.select(
        *rows.columns, F.lit(0).alias("replicate"), F.get("w", 0).alias("wt")
    )
    sums = [F.sum(F.col("wt") * z[i] * z[j]) for i, j in _upper(size)]
    # The range of labels is that of rows that count.
    counted = F.when(F.col("wt") > 0, F.col("y"))
    return long.groupBy(*keys, "replicate").agg(
        F.array(*sums).alias("values"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min(counted).alias("y_low"),
        F.max(counted).alias("y_high"),
    )


def _block_moments(rows: DataFrame, group: Sequence[str], size: int, n_weights: int) -> DataFrame:
    """Sum products block by block inside each task, then element by element across tasks."""
    pairs = _upper(size)
    first, second = (np.array(side) for side in zip(*pairs, strict=True))
    names = [f"x{i}" for i in range(size - 2)]
    group = list(group)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            pieces = batch.groupby(group, sort=False, dropna=False) if group else [((), batch)]
            for key, piece in pieces:
                z = np.column_stack([np.ones(len(piece)), piece[names].to_numpy(float), piece["y"].to_numpy(float)])
                w = np.stack(piece["w"].to_numpy()).astype(float)
                key = key if isinstance(key, tuple) else (key,)
                for b in range(n_weights):
                    entry = sums.setdefault((key, b), [np.zeros((size, size)), 0, np.inf, -np.inf])
                    entry[0] += (z * w[:, b : b + 1]).T @ z
                    entry[1] += len(piece)
                    counted = z[w[:, b] > 0, -1]
                    entry[2], entry[3] = counted.min(initial=entry[2]), counted.max(initial=entry[3])
        for (key, b), (matrix, count, low, high) in sums.items():
            record = {g: [v] for g, v in zip(group, key, strict=True)}
            ends = {"y_low": [low], "y_high": [high]}
            yield pd.DataFrame({**record, "replicate": [b], "n_rows": [count], **ends, "values": [matrix[first, second]]})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in group], "replicate int, n_rows long, y_low double, y_high double, values array<double>"])
    keys = [col(g) for g in group]
    parts = rows.mapInPandas(partial, schema)
    elements = parts.select(*keys, "replicate", "n_rows", "y_low", "y_high", F.posexplode("values").alias("at", "value"))
    summed = elements.groupBy(*keys, "replicate", "at").agg(
        F.sum("value").alias("value"), F.sum("n_rows").alias("n_rows"), F.min("y_low").alias("y_low"), F.max("y_high").alias("y_high")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda e: e["value"])
    return summed.groupBy(*keys, "replicate").agg(
        ordered.alias("values"), *[F.max(c).alias(c) for c in ("n_rows", "y_low", "y_high")]
    )


def solve_ridge(
    stats: Moments, features: Sequence[str], alphas: Sequence[float], standardize: bool = False
) -> list[RidgeModel]:
    """Solve the ridge problem with a free intercept for each strength, from one eigendecomposition."""
    n = stats.weight
    mean = stats.matrix[0, 1:-1] / n
    y_mean = stats.matrix[0, -1] / n
    cross = stats.matrix[1:-1, 1:-1] - n * np.outer(mean, mean)
    target = stats.matrix[1:-1, -1] - n * mean * y_mean
    scale = np.ones(len(mean))
    if standardize:
        deviation = np.sqrt(np.maximum(np.diag(cross), 0.0) / n)
        # A column without spread keeps unit scale.
        tiny = 10 * np.finfo(float).eps * (np.abs(mean + stats.shift) + 1.0)
        scale = np.where(deviation > tiny, deviation, 1.0)
    scaled = cross / np.outer(scale, scale)
    values, vectors = np.linalg.eigh((scaled + scaled.T) / 2)
    projected = vectors.T @ (target / scale)
    models = []
    for alpha in alphas:
        beta = vectors @ (projected / (np.maximum(values, 0.0) + float(alpha))) / scale
        intercept = y_mean - float(beta @ (mean + stats.shift))
        models.append(RidgeModel(tuple(features), beta, intercept))
    return models


def error_scores(model: RidgeModel, stats: Moments) -> tuple[float | None, float | None]:
    """Return rmse and r2 of a model on the rows behind ``stats``, from their moments alone.

    The squared error is a quadratic form: with z = (1, x - shift, y) the error of a row is u'z, so its sum is u'Mu.
    Fewer than two rows have no r2; labels without spread give 1 where nothing is wrong, else 0.
    """
    n = stats.weight
    if n <= 0:
        return None, None
    at_shift = model.intercept + float(model.coefficients @ stats.shift)
    u = np.concatenate(([-at_shift], -model.coefficients, [1.0]))
    error = max(float(u @ stats.matrix @ u), 0.0)
    spread = float(stats.matrix[-1, -1] - stats.matrix[0, -1] ** 2 / n)
    rmse = float(np.sqrt(error / n))
    if n < 2:
        return rmse, None
    if stats.y_range is not None and stats.y_range[0] == stats.y_range[1] or spread <= 0:
        return rmse, 1.0 if error == 0 else 0.0
    return rmse, 1 - error / spread


def add_moments(parts: Sequence[Moments]) -> Moments:
    """Return the moments of all rows of parts with one shifts."""
    return Moments(sum(p.matrix for p in parts), parts[0].shift, sum(p.n_rows for p in parts))


def fold_scores(
    stats: dict[tuple, list[Moments]], features: Sequence[str], alphas: Sequence[float], standardize: bool = False
) -> list[tuple]:
    """Return (fold, replicate, number of the strength, rmse, r2) of every strength, fold and replicate.

    ``stats`` are moments by fold. Each fold is scored by a model of all other rows, those without a fold among them,
    with the weights of the same replicate. No row is read again.
    """
    out = []
    for replicate in range(len(next(iter(stats.values()), []))):
        own = {key[0]: s[replicate] for key, s in stats.items() if s[replicate] is not None}
        whole = add_moments(list(own.values()))
        for fold, held in own.items():
            train = whole - held
            if fold is None or held.weight <= 0 or train.weight <= 0:
                continue
            for i, model in enumerate(solve_ridge(train, features, alphas, standardize)):
                out.append((fold, replicate, i, *error_scores(model, held)))
    return out
