"""Second-order boosted trees by histograms, many fits per pass.

Rows are read once and stored in blocks: one record holds some thousand rows as packed arrays, so a pass over them costs
Spark next to nothing per row. Features are cut into bins once and the binned rows are stored alike. Every level of every
tree of a batch of fits is then one job: tasks add gradients and curvatures per (fit, node, feature, bin), Spark combines
these sums and finds the best split of each node by prefix sums over its bins, and only one row per node reaches the driver.
Fits differ by parameters, by the fold that they leave out and by the resample whose weights they use, so trials, folds and
ensemble members grow together.

The loss is the squared error. Leaves and gains take L1 and L2 penalties; missing values go to the side where they gain more.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaysift.functions.numeric import col, number
from assaysift.session import drop_checkpoint, reliable_checkpoint

#: Bins per feature at most, without the one of missing values.
MAX_BINS = 256
#: Trees after which predictions are stored with the binned rows.
KEEP_TREES = 32
#: Sums that a task holds at most; larger batches of fits are grown in several.
MAX_CELLS = 1 << 22
#: Gains below it count as none.
LEAST_GAIN = 1e-6
#: Rows and bytes of a stored block at most.
BLOCK_ROWS, BLOCK_BYTES = 1 << 14, 1 << 20
#: Counters that one pass of the search for quantiles may bring to the driver, and rows of which it lists values instead.
MAX_COUNTERS, LISTED_ROWS = 1 << 20, 1 << 17
#: Of the stored blocks, so that neither writers nor readers hold more than a few of them at once.
_WRITING = {"parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 10, "parquet.page.size.row.check.min": 10}
_DEFAULTS = {
    "n_estimators": 100,
    "max_depth": 6,
    "learning_rate": 0.3,
    "subsample": 1.0,
    "colsample_bytree": 1.0,
    "reg_alpha": 0.0,
    "reg_lambda": 1.0,
    "min_child_weight": 1.0,
    "random_state": 0,
}


@dataclass(frozen=True)
class TreeFit:
    """What sets one fit of a batch apart: parameters, the fold left out and the number of its resample."""

    params: Mapping[str, Any]
    held_out: Any = None
    replicate: int | None = None

    def get(self, name: str) -> float:
        return float(self.params.get(name, _DEFAULTS[name]))


@dataclass
class Tree:
    """A binary tree in heap order; a node without a feature is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n))


class _Walk:
    """A tree's levels, prepared to be walked by many rows at once; a leaf above the last level ends in both its places there."""

    def __init__(self, tree: Tree) -> None:
        self.steps, self.values, self.alive = [], tree.value[:1], np.ones(1, bool)
        for level in range(len(tree.feature).bit_length() - 1):
            own, below = slice(2**level - 1, 2 ** (level + 1) - 1), slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)
            feature = tree.feature[own]
            if (feature < 0).all():
                break
            self.steps.append((np.maximum(feature, 0).astype(np.intp), (tree.bin[own] + 1).astype(np.uint16), tree.missing_left[own]))
            self.alive = np.repeat(feature >= 0, 2)
            self.values = np.where(self.alive, tree.value[below], np.repeat(self.values, 2))

    def places(self, codes: np.ndarray, missing: bool) -> np.ndarray:
        """Return the place on the last level that every row ends in; ``missing`` tells whether any code is 0."""
        rows = codes.shape[1]
        place, at, flat = np.zeros(rows, np.intp), None, codes.reshape(-1)
        for level, (feature, limit, left) in enumerate(self.steps):
            if (feature == feature[0]).all():
                code = codes[feature[0]]
            else:
                at = np.arange(rows) if at is None else at
                code = flat.take((feature * rows).take(place) + at)
            right = code > (limit.take(place) if level else limit[0])
            if missing:
                right |= (code == 0) & ~(left.take(place) if level else left[0])
            place *= 2
            place += right
        return place

    def add_to(self, margin: np.ndarray, codes: np.ndarray, missing: bool) -> None:
        margin += self.values.take(self.places(codes, missing)) if self.steps else self.values[0]


@dataclass
class TreeModel:
    """Boosted trees on raw feature columns."""

    features: tuple[str, ...]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def scorer(self):
        """Return a function from codes, and whether any is 0, to predictions."""
        base, walks = self.base, [_Walk(t) for t in self.trees]

        def score(codes: np.ndarray, missing: bool) -> np.ndarray:
            out = np.full(codes.shape[1], base)
            for walk in walks:
                walk.add_to(out, codes, missing)
            return out

        return score

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        cuts, score = self.cuts, self.scorer()

        @F.arrow_udf(T.DoubleType())
        def scored(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for own in columns:
                codes = coded([np.asarray(c) for c in own[1:]], cuts, len(own[0]))
                yield pa.array(score(codes, not codes.all()))

        return df.withColumn(out, scored(F.lit(0.0), *_inputs(self.features)))


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = matrix.shape
    ends = pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(matrix).reshape(-1), kind))


def _inputs(features: Sequence[str]) -> list[Column]:
    """Return the features as doubles with NaN for missing values."""
    return [F.coalesce(number(f), F.lit(float("nan"))) for f in features]


def coded(values: Sequence[np.ndarray], cuts: Sequence[np.ndarray], rows: int) -> np.ndarray:
    """Return a row per feature: one more than the number of cuts below each value, 0 for missing values."""
    out = np.zeros((len(cuts), rows), np.uint16)
    for own, ends, column in zip(out, cuts, values, strict=True):
        own[:] = np.searchsorted(ends, column, "left") + 1
        own[np.isnan(column)] = 0
    return out


def predictions(models: Sequence[TreeModel]) -> Column:
    """Return the predictions of models with the same features and cuts, as an array."""
    cuts, scores = models[0].cuts, [m.scorer() for m in models]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for own in columns:
            codes = coded([np.asarray(c) for c in own[1:]], cuts, len(own[0]))
            missing = not codes.all()
            yield _lists(np.stack([f(codes, missing) for f in scores], axis=1), pa.float64())

    # The constant tells the number of rows where there are no features.
    return score(F.lit(0.0), *_inputs(models[0].features))


def _ordered(values: np.ndarray) -> np.ndarray:
    """Return unsigned numbers in the order of the values, NaN last; both zeros are one."""
    bits = np.add(values, 0.0).view(np.int64)
    bits ^= (bits >> 63) & np.int64((1 << 63) - 1)
    return bits.view(np.uint64) ^ np.uint64(1 << 63)


def _from_ordered(keys: np.ndarray) -> np.ndarray:
    """Return the values of ``_ordered`` numbers."""
    bits = (np.asarray(keys, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(np.float64)


class _Cells:
    """A feature's quantiles, searched by cutting the cells that hold them into ever smaller ones.

    Cells are ranges of 2 ** ``shift`` ordered numbers from ``starts`` on, with ``before`` rows below each; all lie in the
    cells of the first pass marked in ``hit``.
    """

    def __init__(self, low: float, high: float, bits: int, max_bins: int) -> None:
        self.low, high = (int(x) for x in _ordered(np.array([low, high])))
        self.max_bins, self.fine = max_bins, max(1, bits - max(max_bins - 1, 1).bit_length())
        self.span = high - self.low
        self.first = self.shift = max(0, self.span.bit_length() - bits)
        self.hit = np.append(np.ones((self.span >> self.shift) + 1, bool), False)
        self.starts = self.before = self.total = None
        self.listing = self.done = False
        self.values = np.zeros(0)

    def counters(self) -> int:
        return len(self.hit) if self.starts is None else len(self.starts) << min(self.fine, self.shift)

    def step(self) -> int:
        """Return the shift of the cells that are counted next."""
        return self.shift if self.starts is None else max(0, self.shift - self.fine)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Return the counters that ordered numbers add to, or the numbers in question if they are listed."""
        off = keys - np.uint64(self.low)
        # Only missing values lie above the largest one.
        coarse = np.where(off <= np.uint64(self.span), off >> np.uint64(self.first), np.uint64(len(self.hit) - 1)).astype(np.intp)
        if self.starts is None:
            return coarse[coarse < len(self.hit) - 1]
        keys = keys[self.hit.take(coarse)]
        cell = np.searchsorted(self.starts, keys, "right") - 1
        off = keys - self.starts.take(np.maximum(cell, 0))
        inside = (cell >= 0) & (off >> np.uint64(self.shift) == 0)
        if self.listing:
            return keys[inside]
        wide = self.shift - self.step()
        return (cell[inside] << wide) | (off[inside] >> np.uint64(self.step())).astype(np.intp)

    def take(self, number: np.ndarray, n: np.ndarray) -> None:
        """Go on to the cells that hold quantiles, given the counters that are not 0, in order."""
        if self.listing:
            starts = number.view(np.uint64)
            step, cell = 0, np.searchsorted(self.starts, starts, "right") - 1
        elif self.starts is None:
            step, cell, self.total = self.shift, np.zeros(len(number), np.intp), int(n.sum())
            starts = (number.astype(np.uint64) << np.uint64(step)) + np.uint64(self.low)
        else:
            step = self.step()
            wide = self.shift - step
            cell = number >> wide
            starts = self.starts[cell] + ((number - (cell << wide)).astype(np.uint64) << np.uint64(step))
        up_to = np.cumsum(n)
        before = up_to - n
        if self.before is not None:
            # Counts start anew in every cell of the pass before.
            before = before - before[np.searchsorted(cell, cell, "left")] + self.before[cell]
        # A quantile lies where a multiple of 1 / max_bins of the rows ends: in at most max_bins cells.
        held = (before + n) * self.max_bins // self.total > before * self.max_bins // self.total
        self.starts, self.before, self.shift = starts[held], before[held], step
        if self.shift == 0:
            self.done, self.values = True, _from_ordered(self.starts)
            return
        self.hit[:] = False
        self.hit[((self.starts - np.uint64(self.low)) >> np.uint64(self.first)).astype(np.intp)] = True
        self.listing = int(n[held].sum()) <= LISTED_ROWS


#: Arrays of a block, of a number per row or several; those that no fit needs are empty, as are predictions before the first.
_KINDS = {"row": np.int64, "x": np.float64, "codes": np.uint16, "y": np.float64, "code": np.int32, "w": np.float64, "pred": np.float64}
_RAW, _BINNED = ("row", "x", "y", "code", "w"), ("row", "codes", "y", "code", "w", "pred")


def _schema(names: Sequence[str]) -> str:
    return "n int, " + ", ".join(f"{name} binary" for name in names)


def _record(names: Sequence[str], n: int, arrays: Sequence[Any]) -> pa.RecordBatch:
    packed = [pa.array([np.ascontiguousarray(x, _KINDS[name]).tobytes()], pa.binary()) for name, x in zip(names, arrays, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *packed], ["n", *names])


def _arrays(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """Read the records of a stored table; arrays of several numbers per row have a row for each."""
    for k in range(batch.num_rows):
        n = batch.column(0)[k].as_py()
        found = {name: np.frombuffer(c[k].as_buffer() or b"", _KINDS[name]) for name, c in zip(names, batch.columns[1:], strict=True)}
        if len(found["row"]) == 1:
            # Row numbers without gaps are stored by the first.
            found["row"] = found["row"][0] + np.arange(n)
        yield found | {name: x.reshape(-1, n) for name, x in found.items() if name in ("x", "codes", "w", "pred")}


def _raw_blocks(rows: DataFrame, features: Sequence[str], more: Sequence[Column] = (), folds: bool = False) -> DataFrame:
    """Store the features, and more columns: the label, the code of the fold if there are folds, and weights."""
    n_features, n_more = len(features), len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * (n_features + n_more + 1))))
        nothing = np.zeros(0)
        # The numbers that monotonically_increasing_id would give.
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                columns = [np.asarray(c) for c in part.columns]
                x, (y, *w) = columns[:n_features], columns[n_features:] or [nothing]
                code = w.pop(0) if folds else nothing
                yield _record(_RAW, len(columns[0]), [[row], x, y, code, w])
                row += len(columns[0])

    named = [x.alias(f"c{i}") for i, x in enumerate([*_inputs(features), *more])]
    return reliable_checkpoint(rows.select(*named).mapInArrow(run, _schema(_RAW)), **_WRITING)


def _quantiles(raw: DataFrame, ends: Mapping[int, tuple[float, float]], max_bins: int) -> dict[int, np.ndarray]:
    """Return the exact quantiles of the features numbered in ``ends``, given the smallest and largest value of each."""
    bits = max(10, min(16, (MAX_COUNTERS // len(ends)).bit_length() - 1))
    cells = {f: _Cells(low, high, bits, max_bins) for f, (low, high) in ends.items()}
    while open_ := {f: c for f, c in cells.items() if not c.done}:

        def count(batches: Iterator[pa.RecordBatch], open_=open_) -> Iterator[pa.RecordBatch]:
            sums = {f: np.zeros(0 if c.listing else c.counters(), np.int64) for f, c in open_.items()}
            waiting: dict[int, list[np.ndarray]] = {f: [] for f in open_}
            listed: dict[int, list[np.ndarray]] = {f: [] for f in open_}

            def add(f: int) -> None:
                found = np.concatenate(waiting[f])
                if open_[f].listing:
                    listed[f].append(found)
                else:
                    sums[f] += np.bincount(found, minlength=len(sums[f]))
                waiting[f] = []

            for batch in batches:
                for block in _arrays(batch, _RAW):
                    for f, c in open_.items():
                        waiting[f].append(c.numbers(_ordered(block["x"][f])))
                        if sum(map(len, waiting[f])) > len(sums[f]) or len(waiting[f]) > 99:
                            add(f)
            for f, c in open_.items():
                if waiting[f]:
                    add(f)
                if c.listing:
                    number_of, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *listed[f]]), return_counts=True)
                else:
                    number_of = np.flatnonzero(sums[f])
                    n = sums[f][number_of]
                columns = [np.full(len(n), f, np.int32), number_of.view(np.int64), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["feature", "number", "n"])

        # At most MAX_COUNTERS counters, or 1,024 a feature, and LISTED_ROWS values a feature reach the driver.
        parts = raw.mapInArrow(count, "feature int, number long, n long")
        found = parts.groupBy("feature", "number").agg(F.sum("n").alias("n")).toArrow()
        feature, number_of, n = (np.asarray(found.column(c)) for c in ("feature", "number", "n"))
        for f, c in open_.items():
            own = np.flatnonzero(feature == f)
            own = own[np.argsort(number_of[own].view(np.uint64), kind="stable")]
            c.take(number_of[own], n[own])
    return {f: c.values for f, c in cells.items()}


def feature_cuts(rows: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Return the upper ends of each feature's bins.

    A feature of up to ``max_bins`` distinct values has one bin per value; others are cut along exact quantiles, so equal
    rows give equal cuts in whatever order tasks end.
    """
    if not features:
        return []
    raw = _raw_blocks(rows, features)
    cuts = _cuts(raw, len(features), max_bins)
    drop_checkpoint(raw)
    return cuts


def _cuts(raw: DataFrame, n_features: int, max_bins: int) -> list[np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ends = [np.zeros(0)] * n_features, [np.zeros(0)] * n_features
        for i, values in ((i, x) for batch in batches for block in _arrays(batch, _RAW) for i, x in enumerate(block["x"])):
            column = values + 0.0
            column = column[~np.isnan(column)]
            if not len(column):
                continue
            ends[i] = np.array([min([column.min(), *ends[i]]), max([column.max(), *ends[i]])])
            if len(seen[i]) <= max_bins:
                at = np.searchsorted(seen[i], column)
                known = seen[i].take(at, mode="clip") == column if len(seen[i]) else np.zeros(len(column), bool)
                if not known.all():
                    seen[i] = np.unique(np.concatenate((seen[i], column[~known])))[: max_bins + 1]
        for of_ends, found in ((False, seen), (True, ends)):
            at = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate(found)), pa.array(np.full(len(at), of_ends))], ["feature", "value", "of_ends"])

    if not n_features:
        return []
    # At most max_bins + 3 values per feature and task arrive here.
    distinct = reliable_checkpoint(raw.mapInArrow(run, "feature int, value double, of_ends boolean").distinct())
    few = distinct.groupBy("feature").agg(F.count_if(~F.col("of_ends")).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    ends = {r["feature"]: (r["low"], r["high"]) for r in few.where(F.col("n") > max_bins).collect()}
    small = distinct.where(~F.col("of_ends") & ~F.col("feature").isin(list(ends)))
    found: dict[int, list[float]] = {i: [] for i in range(n_features)}
    for r in small.collect():
        found[r["feature"]].append(r["value"])
    drop_checkpoint(distinct)
    large = _quantiles(raw, ends, max_bins) if ends else {}
    return [large[i] if i in large else np.unique(np.array(found[i], dtype=float)) for i in range(n_features)]


def _uniform(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Return a number from [0, 1) per row that depends on its number, the seed and the tree alone."""
    x = rows.astype(np.uint64)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x += np.uint64((seed * 1_000_003 + tree * 7_919 + 1) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _chosen_features(fit: TreeFit, tree: int, n: int) -> list[int]:
    """Return the features that a tree may split on."""
    share = fit.get("colsample_bytree")
    if share >= 1:
        return list(range(n))
    rng = np.random.default_rng([int(fit.get("random_state")), tree])
    return sorted(rng.choice(n, max(1, int(share * n)), replace=False).tolist())


_HISTOGRAM = "fit int, node int, feature int, bin int, g double, h double"


class _Block:
    """Some stored rows, as arrays."""

    def __init__(self, arrays: Mapping[str, np.ndarray]) -> None:
        self.codes, self.y, self.row, self.code, self.w, self.pred = (arrays[x] for x in ("codes", "y", "row", "code", "w", "pred"))
        self.missing = not self.codes.all()


class _Batch:
    """The fits that grow together and the stored rows that they read."""

    def __init__(self, raw: DataFrame, features: Sequence[str], cuts: list[np.ndarray], fits: Sequence[TreeFit],
                 folds: Sequence[Any], replicates: Sequence[int]) -> None:
        self.features, self.cuts, self.fits, self.folds, self.replicates = tuple(features), cuts, list(fits), folds, replicates
        per_row = 2 * len(cuts) + 8 * (3 + len(replicates) + len(fits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // per_row))
            for batch in batches:
                for block in _arrays(batch, _RAW):
                    used = np.flatnonzero(~np.isnan(block["y"]))
                    for at in range(0, len(used), size):
                        own = used[at : at + size]
                        row, x, y, code, w = (block[name] for name in _RAW)
                        own_rows = row[own]
                        gaps = own_rows[-1] - own_rows[0] != len(own) - 1
                        codes = coded([c[own] for c in x], cuts, len(own))
                        yield _record(_BINNED, len(own), [own_rows if gaps else own_rows[:1], codes, y[own], code[own] if len(code) else code, w[:, own], []])

        self.table = reliable_checkpoint(raw.mapInArrow(run, _schema(_BINNED)), **_WRITING)
        self.models = [TreeModel(self.features, cuts, 0.0) for _ in fits]
        self._set_bases()
        self.kept = 0

    def _set_bases(self) -> None:
        n_codes, replicates = len(self.folds) + 1, [-1, *self.replicates]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, len(replicates), n_codes))
            for batch in batches:
                for block in map(_Block, _arrays(batch, _BINNED)):
                    code = block.code.astype(np.intp) + 1 if n_codes > 1 else np.zeros(len(block.y), np.intp)
                    for k, w in enumerate((np.ones(len(block.y)), *block.w)):
                        sums[0, k] += np.bincount(code, w * block.y, n_codes)
                        sums[1, k] += np.bincount(code, w, n_codes)
            replicate, code = (x.reshape(-1).astype(np.int32) for x in np.meshgrid(replicates, np.arange(n_codes) - 1, indexing="ij"))
            columns = [replicate, code, sums[0].reshape(-1), sums[1].reshape(-1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["replicate", "code", "y", "n"])

        parts = self.table.mapInArrow(run, "replicate int, code int, y double, n double")
        totals = parts.groupBy("replicate", "code").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).collect()
        for fit, model in zip(self.fits, self.models, strict=True):
            own = [r for r in totals if r["replicate"] == (-1 if fit.replicate is None else fit.replicate)]
            used = sorted((r["code"], r) for r in own if fit.held_out is None or r["code"] != self.folds.index(fit.held_out))
            n = sum(r["n"] for _, r in used)
            model.base = sum(r["y"] for _, r in used) / n if n else 0.0

    def _margins(self, chosen: Sequence[int]):
        """Return a function from a block and one of the chosen fits to its margins."""
        bases = {i: self.models[i].base for i in chosen}
        walks = {i: [_Walk(t) for t in self.models[i].trees[self.kept :]] for i in chosen}

        def margin(block: _Block, i: int) -> np.ndarray:
            out = block.pred[i].copy() if len(block.pred) else np.full(len(block.y), bases[i])
            for walk in walks[i]:
                walk.add_to(out, block.codes, block.missing)
            return out

        return margin

    def keep(self) -> None:
        """Store the predictions so far with the rows."""
        n = len(self.fits)
        margin = self._margins(range(n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, arrays in enumerate(_arrays(batch, _BINNED)):
                    pred = np.stack([margin(_Block(arrays), i) for i in range(n)])
                    own = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array([pred.tobytes()], pa.binary())], own.schema.names)

        old = self.table
        self.table = reliable_checkpoint(old.mapInArrow(run, _schema(_BINNED)), **_WRITING)
        drop_checkpoint(old)
        self.kept = max(len(m.trees) for m in self.models)

    def splits(self, growing: dict[int, Tree], level: int, number_of: int) -> list:
        """Return the best split of every node of a level: one row per (fit, node) with its sums and gain."""
        fits, margin = self.fits, self._margins(list(growing))
        n, width = len(self.features), max((len(c) for c in self.cuts), default=0) + 2
        first, count = 2**level - 1, 2**level
        allowed = {i: _chosen_features(fits[i], number_of, n) for i in growing}
        walks = {i: _Walk(t) for i, t in growing.items()}
        weight_of = {i: None if fits[i].replicate is None else self.replicates.index(fits[i].replicate) for i in growing}
        left_out = {i: None if fits[i].held_out is None else self.folds.index(fits[i].held_out) for i in growing}
        # Rows that are not used, or in a leaf above, go to a node of their own.
        nodes = {i: np.where(w.alive, np.arange(count), count) for i, w in walks.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {i: np.zeros((2, len(allowed[i]), count * width)) for i in growing}

            def used(block: _Block, i: int, drawn: dict) -> tuple[np.ndarray | None, np.ndarray | None]:
                """Return which rows count and their weights, None for all and for ones."""
                weight = None if weight_of[i] is None else block.w[weight_of[i]]
                by = [] if weight is None else [weight > 0]
                if left_out[i] is not None:
                    by.append(block.code != left_out[i])
                share, seed = fits[i].get("subsample"), int(fits[i].get("random_state"))
                if share < 1:
                    if seed not in drawn:
                        drawn[seed] = _uniform(block.row, seed, number_of)
                    by.append(drawn[seed] < share)
                return (np.logical_and.reduce(by) if by else None), weight

            for batch in batches:
                for block in map(_Block, _arrays(batch, _BINNED)):
                    drawn: dict[int, np.ndarray] = {}
                    for i in growing:
                        counted, weight = used(block, i, drawn)
                        g = margin(block, i)
                        g -= block.y
                        if weight is not None:
                            g *= weight
                        node = nodes[i].take(walks[i].places(block.codes, block.missing))
                        if counted is not None:
                            node[~counted] = count
                        node *= width
                        for place, f in enumerate(allowed[i]):
                            cell = node + block.codes[f]
                            for k, x in enumerate((g, weight)):
                                sums[i][k, place] += np.bincount(cell, x, (count + 1) * width)[: count * width]
            for i, (g, h) in sums.items():
                place, cell = np.nonzero(h)
                columns = [np.full(len(place), i), cell // width + first, np.array(allowed[i], np.int64)[place], cell % width - 1]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x.astype(np.int32)) for x in columns], pa.array(g[place, cell]), pa.array(h[place, cell])],
                    ["fit", "node", "feature", "bin", "g", "h"],
                )

        # Tasks have combined their own rows; one exchange by (fit, node, feature) serves the sums and the prefix sums.
        parts = self.table.mapInArrow(run, _HISTOGRAM).repartition("fit", "node", "feature")
        cells = parts.groupBy("fit", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        return best_splits(cells, self.fits).collect()

    def grow(self) -> list[TreeModel]:
        """Add trees to all models until each has as many as its fit asks for."""
        rounds = [int(f.get("n_estimators")) for f in self.fits]
        for number_of in range(max(rounds, default=0)):
            growing = {i: Tree.empty(int(self.fits[i].get("max_depth"))) for i in range(len(self.fits)) if number_of < rounds[i]}
            trees = dict(growing)
            level = 0
            while growing:
                open_: set[int] = set()
                for row in self.splits(growing, level, number_of):
                    i, tree = row["fit"], growing[row["fit"]]
                    rate = self.fits[i].get("learning_rate")
                    if level == 0:
                        tree.value[0] = row["value"] * rate
                    if level < int(self.fits[i].get("max_depth")) and row["gain"] > LEAST_GAIN:
                        node = row["node"]
                        tree.feature[node], tree.bin[node], tree.missing_left[node] = row["feature"], row["bin"], row["missing_left"]
                        tree.gain[node] = row["gain"]
                        tree.value[2 * node + 1], tree.value[2 * node + 2] = row["left_value"] * rate, row["right_value"] * rate
                        open_.add(i)
                level += 1
                growing = {i: t for i, t in growing.items() if i in open_ and level < int(self.fits[i].get("max_depth"))}
            for i, tree in trees.items():
                self.models[i].trees.append(tree)
            if (number_of + 1) % KEEP_TREES == 0 and number_of + 1 < max(rounds):
                for i in set(range(len(self.fits))) - set(trees):
                    # Fits that are done wait with trees of nothing, so all have the same number.
                    self.models[i].trees += [Tree.empty(0)] * (number_of + 1 - len(self.models[i].trees))
                self.keep()
        drop_checkpoint(self.table)
        return self.models


def _penalised(g: Column, alpha: Column) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))


def best_splits(cells: DataFrame, fits: Sequence[TreeFit]) -> DataFrame:
    """Return the best split of every (fit, node) of a histogram (fit, node, feature, bin, g, h), bin -1 for missing values.

    A row goes left up to and including ``bin``; missing values go left only if that gains more. A side lighter than the
    fit's min_child_weight is no split. Equal gains go to the smaller feature, then the smaller bin. ``value`` is what the
    node would be as a leaf, ``gain`` is -1 without a split.
    """

    def of(name: str) -> Column:
        return F.get(F.array(*[F.lit(f.get(name)) for f in fits]), F.col("fit"))

    alpha, lam, least = of("reg_alpha"), of("reg_lambda"), of("min_child_weight")

    def quality(g: Column, h: Column) -> Column:
        return F.coalesce(F.try_divide(F.pow(_penalised(g, alpha), F.lit(2)), h + lam), F.lit(0.0))

    def value(g: Column, h: Column) -> Column:
        return F.coalesce(F.try_divide(-_penalised(g, alpha), h + lam), F.lit(0.0))

    # At most one row per bin reaches a window partition.
    feature = Window.partitionBy("fit", "node", "feature")
    up_to = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("bin") >= 0
    sums = cells.select(
        "*",
        *[F.sum(c).over(feature).alias(f"{c}_all") for c in "gh"],
        *[F.coalesce(F.sum(F.when(~known, F.col(c))).over(feature), F.lit(0.0)).alias(f"{c}_missing") for c in "gh"],
        *[F.coalesce(F.sum(F.when(known, F.col(c))).over(up_to), F.lit(0.0)).alias(f"{c}_left") for c in "gh"],
    )
    sides = F.array(
        F.struct(F.lit(False).alias("missing_left"), F.col("g_left").alias("gl"), F.col("h_left").alias("hl")),
        F.struct(F.lit(True).alias("missing_left"), (F.col("g_left") + F.col("g_missing")).alias("gl"), (F.col("h_left") + F.col("h_missing")).alias("hl")),
    )
    tried = sums.select("*", F.explode(sides).alias("side")).select("*", "side.*")
    gr, hr = F.col("g_all") - F.col("gl"), F.col("h_all") - F.col("hl")
    gain = quality(F.col("gl"), F.col("hl")) + quality(gr, hr) - quality(F.col("g_all"), F.col("h_all"))
    heavy = known & (F.col("hl") >= least) & (hr >= least) & (F.col("hl") > 0) & (hr > 0)
    rated = tried.select(
        "fit",
        "node",
        "feature",
        "bin",
        "missing_left",
        F.when(heavy, gain).otherwise(F.lit(-1.0)).alias("gain"),
        value(F.col("gl"), F.col("hl")).alias("left_value"),
        value(gr, hr).alias("right_value"),
        value(F.col("g_all"), F.col("h_all")).alias("value"),
    )
    first = F.struct("gain", -F.col("feature"), -F.col("bin"), ~F.col("missing_left"))
    out = ["feature", "bin", "missing_left", "gain", "left_value", "right_value", "value"]
    return rated.groupBy("fit", "node").agg(F.max_by(F.struct(*out), first).alias("best")).select("fit", "node", "best.*")


def fit_many(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    fits: Sequence[TreeFit],
    fold: str | None = None,
    weights: str | None = None,
    max_bins: int = MAX_BINS,
) -> list[TreeModel]:
    """Fit all ``fits`` on ``rows``, level by level together.

    A fit leaves out the rows whose ``fold`` equals its ``held_out`` and weighs the others by its element of the array
    column ``weights``. Bins come from all rows. Rows without a label count for nothing, and a fit without rows predicts 0.
    """
    folds = list(dict.fromkeys(f.held_out for f in fits if f.held_out is not None))
    replicates = sorted({f.replicate for f in fits if f.replicate is not None})
    code = F.lit(-1)
    for i, value in enumerate(folds):
        code = F.when(col(fold).eqNullSafe(F.lit(value)), i).otherwise(code)
    # Columns of plain numbers, as arrays are slow to hand over. A row without a weight counts for nothing.
    drawn = [F.coalesce(F.get(col(weights).cast("array<double>"), r), F.lit(0.0)) for r in replicates]
    y = F.coalesce(number(label), F.lit(float("nan")))
    raw = _raw_blocks(rows, features, [y, *([code.cast("int")] if folds else []), *drawn], bool(folds))
    cuts = _cuts(raw, len(features), max_bins)
    width = sum(len(c) + 2 for c in cuts) or 1
    out: list[TreeModel] = []
    batch: list[TreeFit] = []
    size = 0

    def flush() -> None:
        if batch:
            out.extend(_Batch(raw, features, cuts, batch, folds, replicates).grow())
            batch.clear()

    for fit in fits:
        need = 2 * width << max(int(fit.get("max_depth")) - 1, 0)
        if batch and size + need > MAX_CELLS:
            flush()
            size = 0
        batch.append(fit)
        size += need
    flush()
    drop_checkpoint(raw)
    return out
