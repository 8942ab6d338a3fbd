"""Approximate nearest neighbours by stable projections, a kd-tree on them and a chi-square stopping test.

Vectors are made equally long by one more component (queries have zero there), so that the largest inner product is the
smallest distance. A few Gaussian projections keep distances in the following sense: the squared distance of two projected
points is their squared distance times a chi-square variable. So leaves of candidates are met in ascending projected distance
and rows verified on their whole vectors, unless the projected distance is one that a neighbour as close as the k-th best so
far would stay below with the wanted confidence. Nothing else ends a search: there is no limit on candidates.

The upper levels of the kd-tree are fitted on a bounded sample of projected rows and deal all rows into cells; a cell with
more rows than a unit of work holds is dealt into several by digest. The lower levels are built by the task that reads a
unit, for all queries that visit it together. A query first searches its own cell, then those other cells that the test
cannot rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as win

from assaysift.session import reliable_checkpoint

#: Rows of a unit of work on average, and of a leaf of its tree at most.
UNIT_ROWS, LEAF_ROWS = 4_096, 128
#: Cells at most and sampled rows per cell; together they bound what the driver holds and broadcasts to a few megabytes.
MOST_CELLS, FIT_ROWS = 4_096, 16
#: Searches that one copy of a unit serves; a unit that more queries visit is read by several tasks.
UNIT_SEARCHES = 8_192
#: Queries that are searched together.
_QUERIES = 1_024
#: Pairs whose final scores are summed at once.
_PAIRS = 8_192


def chi_square_quantile(confidence: float, degrees: int) -> float:
    """Return the quantile of the chi-square distribution with an even number of degrees of freedom."""
    if degrees < 2 or degrees % 2 or not 0 < confidence < 1:
        raise ValueError("an even number of degrees and a confidence between 0 and 1 are needed")

    def above(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1.0
    while above(high) > 1 - confidence:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > 1 - confidence else (low, middle)
    return high


def usable(vector: Column) -> Column:
    """Return whether a vector is neither null, nor zero, nor holds null or non-finite components."""
    # NaN is the largest number here.
    low, high, infinite = F.array_min(vector), F.array_max(vector), F.lit(math.inf)
    return (low > -infinite) & (high < infinite) & ((low < 0) | (high > 0)) & F.forall(vector, lambda x: x.isNotNull())


def _sound(vectors: DataFrame) -> DataFrame:
    named = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return named.filter(F.col("id").isNotNull() & usable(F.col("v")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Return a list column as a matrix, shorter lists filled up with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _lists(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def _packed(matrix: np.ndarray) -> pa.Array:
    """Return rows as bytes, which pass between Spark and Python far faster than lists."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(8 * matrix.shape[1])
    flat = pa.py_buffer(np.ascontiguousarray(matrix, dtype="<f8"))
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), flat])


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width))
    _, ends, flat = column.cast(pa.binary()).buffers()
    start = np.frombuffer(ends, np.int32)[column.offset]
    return np.frombuffer(flat, "<f8", len(column) * width, start).reshape(-1, width)


def fit_cells(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Return the split dimension and cut of every inner node of a balanced kd-tree, level by level."""
    dims, cuts = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1)
    own = {0: points}
    for node in range(len(dims)):
        rows = own.pop(node)
        if len(rows):
            dims[node] = np.argmax(rows.max(0) - rows.min(0))
            cuts[node] = np.median(rows[:, dims[node]])
        right = rows[:, dims[node]] > cuts[node]
        own[2 * node + 1], own[2 * node + 2] = rows[~right], rows[right]
    return dims, cuts


def cells_of(points: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Return the cell of every point."""
    node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[rows, dims[node]] > cuts[node])
    return node - len(dims)


def gaps(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Return the squared distance of a point to every box."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return np.einsum("...j,...j->...", gap, gap)


class Unit:
    """The lower levels of the tree over the rows of one unit, whose leaves are runs of rows."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, points: np.ndarray) -> None:
        order, ranges = np.arange(len(points)), [(0, len(points))]
        while ranges[0][1] - ranges[0][0] > LEAF_ROWS:
            halves = []
            for a, b in ranges:
                own, middle = points[order[a:b]], (b - a) // 2
                widest = np.argmax(own.max(0) - own.min(0))
                order[a:b] = order[a:b][np.argpartition(own[:, widest], middle)]
                halves += [(a, a + middle), (a + middle, b)]
            ranges = halves
        self.starts = np.array([a for a, _ in ranges])
        self.ends = np.array([b for _, b in ranges])
        self.vectors, self.points = vectors[order], points[order]
        # A first look at inner products takes single precision, scaled so that none overflows.
        self.scale = math.sqrt(max(np.einsum("ij,ij->i", vectors, vectors).max(initial=0), 1e-300))
        self.rough = (self.vectors / self.scale).astype(np.float32)
        self.low = np.minimum.reduceat(self.points, self.starts)
        self.high = np.maximum.reduceat(self.points, self.starts)
        # Rows of equal vectors are one point with several ids.
        at = np.asarray(ids.offsets)
        self.ids, self.first, self.copies = np.asarray(ids.flatten()), (at - at[0])[:-1][order], np.diff(at)[order]

    def search(
        self,
        queries: np.ndarray,
        points: np.ndarray,
        own: np.ndarray,
        k: int,
        least: np.ndarray,
        spread: float,
        reach: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Return (row of ``queries``, id, score): of each query the k largest inner products of at least its ``least``.

        They come by query, best first, ties to smaller ids. ``spread`` is the quantile of the stopping test, ``reach`` the
        sum of the squared lengths of both sides. All queries advance together, each through its own leaves in ascending
        distance, in steps that double; the test is made anew before every step. Where all queries come with a bound, which
        few rows here can raise, one step takes all leaves that the test leaves.
        """
        least = least.copy()
        size = np.sqrt(np.maximum(np.einsum("ij,ij->i", queries, queries), 1e-300))
        rough, unit_length = (queries / size[:, None]).astype(np.float32), self.scale * size
        # Projected distances are one product, |p|^2 - 2 pq + |q|^2, scaled so that none overflows.
        shift = math.sqrt(min(max(reach.max(initial=0), 1e-300), 1e300))
        near, held = points / shift, self.points / shift
        left = np.column_stack((-2 * near, np.ones(len(near)), np.einsum("ij,ij->i", near, near)))
        right = np.column_stack((held, np.einsum("ij,ij->i", held, held), np.ones(len(held))))
        boxes = gaps(near[:, None], self.low / shift, self.high / shift)
        turn = np.argsort(np.argsort(boxes, axis=1, kind="stable"), axis=1)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        opened, step = 0, len(self.starts) if np.isfinite(least).all() else 2
        while opened < len(self.starts):
            # What rounding may add to a distance is allowed for.
            far = (spread * np.maximum(reach - 2 * least, 0) + 1e-10 * reach) / shift**2
            # Rounding to single precision shifts a product by far less than a ten-thousandth of both lengths.
            floor = (least / unit_length - 1e-4).astype(np.float32)
            opens = (turn >= opened) & (turn < opened + step) & (boxes <= far[:, None])
            opened += step
            step *= 2
            met = []
            for leaf in np.flatnonzero(opens.any(0)):
                a, b = self.starts[leaf], self.ends[leaf]
                at = np.flatnonzero(opens[:, leaf])
                inside = left[at] @ right[a:b].T <= far[at, None]
                dense = 8 * np.count_nonzero(inside) > inside.size
                if dense:
                    # Where the test leaves many pairs, a product of matrices costs less than picking them out.
                    inside &= rough[at] @ self.rough[a:b].T >= floor[at, None]
                query, row = divmod(np.flatnonzero(inside), b - a)
                query, row = at[query], a + row
                if not dense:
                    kept = np.einsum("ij,ij->i", rough[query], self.rough[row]) >= floor[query]
                    query, row = query[kept], row[kept]
                met.append((query, row))
            if sum(len(x) for x, _ in met):
                query, row = (np.concatenate(x) for x in zip(*met, strict=True))
                found = self._merge(found, queries, query, row, own, least)
            if len(found[0]):
                found = _best(*found, k)
                # Queries with k rows: the last one of each is its bound.
                ends = np.cumsum(np.bincount(found[0], minlength=len(queries)))
                full = np.flatnonzero(np.diff(ends, prepend=0) == k)
                least[full] = np.maximum(least[full], found[2][ends[full] - 1])
        return found

    def _merge(self, found: tuple, queries: np.ndarray, query: np.ndarray, row: np.ndarray, own: np.ndarray, least: np.ndarray):
        """Return ``found`` with the ids and final scores of pairs that reach ``least``."""
        # Final scores are summed in the order of components, so they do not depend on the batch.
        starts = range(0, len(query), _PAIRS)
        exact = [np.cumsum(self.vectors[row[i : i + _PAIRS]] * queries[query[i : i + _PAIRS]], axis=1)[:, -1] for i in starts]
        exact = np.concatenate(exact)
        kept = exact >= least[query]
        query, row, exact = query[kept], row[kept], exact[kept]
        counts = self.copies[row]
        place = np.repeat(self.first[row] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        query, ids, exact = np.repeat(query, counts), self.ids[place], np.repeat(exact, counts)
        kept = ids != own[query]
        return tuple(np.concatenate(x) for x in zip(found, (query[kept], ids[kept], exact[kept]), strict=True))


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return the k best rows of each query, by query, best first, ties to smaller ids."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    kept = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query))) < k
    return query[kept], ids[kept], scores[kept]


@dataclass
class Index:
    """A stored table (cell, ids, v as bytes, digest) of all distinct vectors with what is needed to search it."""

    table: DataFrame
    cells: DataFrame
    dims: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    axes: np.ndarray
    length: float
    most: int

    @property
    def width(self) -> int:
        return len(self.axes) - 1


def _project(vectors: np.ndarray, axes: np.ndarray, length: float | None) -> np.ndarray:
    """Project rows; with ``length``, filled up to that squared length by the last component."""
    points = vectors @ axes[:-1]
    if length is not None:
        own = np.einsum("ij,ij->i", vectors, vectors)
        points += np.sqrt(np.maximum(length - own, 0))[:, None] * axes[-1]
    return points


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def build_index(vectors: DataFrame, k: int = 20, projections: int = 16, seed: int = 42) -> Index:
    """Index every row of ``vectors`` (id, v) for searches of up to ``k`` neighbours.

    Rows without an id, and vectors that are null, zero or hold null or non-finite components, take no part; shorter
    vectors count as filled up with zeros. Rows that repeat id and vector count once. Rows of equal vectors are one point,
    of which the k + 1 smallest ids are kept: no other one can be among k neighbours.
    """
    spark = vectors.sparkSession
    # Sorting meets the digest first, which is far cheaper to compare than a vector.
    per_vector = win.Window.partitionBy("digest", "v").orderBy("id")
    points = (
        _sound(vectors)
        .withColumn("digest", F.xxhash64("v"))
        .withColumn("n", F.dense_rank().over(per_vector))
        .filter(F.col("n") <= k + 1)
        .groupBy("digest", "v")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )
    points = reliable_checkpoint(points.select("ids", "v", "digest"))
    own = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    row = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(own).alias("length")).first()
    width, length = row["width"] or 1, row["length"] or 0.0
    if not math.isfinite(length):
        raise ValueError("the squared length of a vector exceeds the range of doubles")
    axes = np.random.default_rng(seed).standard_normal((width + 1, projections))
    unit_rows = max(LEAF_ROWS, UNIT_ROWS * 64 // max(width, 64))
    levels = max(0, min(math.ceil(math.log2(max(row["n"], 1) / unit_rows)), MOST_CELLS.bit_length() - 1))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            yield pa.RecordBatch.from_arrays([_lists(_project(_matrix(batch.column(0), width), axes, length))], ["p"])

    sample = points.orderBy("digest").limit(FIT_ROWS << levels).select("v").mapInArrow(project, "p array<double>").toArrow()
    dims, cuts = fit_cells(_matrix(sample.column("p").combine_chunks(), projections) if len(sample) else np.zeros((0, projections)), levels)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            v = _matrix(batch.column(1), width)
            p = _project(v, axes, length)
            cell = pa.array(cells_of(p, dims, cuts), pa.int32())
            columns = [cell, batch.column(0), _packed(v), batch.column(2), _lists(p)]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "ids", "v", "digest", "p"])

    schema = "cell int, ids array<long>, v binary, digest long, p array<double>"
    table = reliable_checkpoint(points.mapInArrow(place, schema))
    edges = [f(F.col("p")[i]).alias(f"{name}{i}") for i in range(projections) for name, f in (("low", F.min), ("high", F.max))]
    # At most MOST_CELLS rows.
    rows = {r["cell"]: r for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges).collect()}
    table = table.select("cell", "ids", "v", "digest")
    low, high = np.full((1 << levels, projections), np.inf), np.full((1 << levels, projections), np.inf)
    entries, first = [], 0
    for cell in range(1 << levels):
        if cell in rows:
            low[cell] = [rows[cell][f"low{i}"] for i in range(projections)]
            high[cell] = [rows[cell][f"high{i}"] for i in range(projections)]
            units = -(-rows[cell]["n"] // unit_rows)
            entries.append((cell, first, units))
            first += units
    cells = spark.createDataFrame(entries, "cell int, first long, units long")
    return Index(table, cells, dims, cuts, low, high, axes, length, k)


def _visit(index: Index, visits: DataFrame, k: int, spread: float) -> DataFrame:
    """Return (query_id, vec_id, score, nth of the visit) of every visit (unit, id, v, least).

    Rows of a unit and its searches meet in one sorted partition that is read as a stream, rows first. A unit that many
    queries visit is copied once per UNIT_SEARCHES of them.
    """
    # One row per unit.
    copies = F.broadcast(visits.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / UNIT_SEARCHES).cast("long").alias("copies")))
    none = F.lit(None)
    held = (
        index.table.join(F.broadcast(index.cells), "cell")
        .withColumn("unit", F.col("first") + F.pmod("digest", F.col("units")))
        .join(copies, "unit")
        .select(
            "unit",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"),
            F.lit(0).alias("kind"),
            none.cast("long").alias("id"),
            "ids",
            "v",
            none.cast("double").alias("least"),
        )
    )
    asked = visits.join(copies, "unit").select(
        "unit",
        F.pmod(F.xxhash64("id"), F.col("copies")).alias("copy"),
        F.lit(1).alias("kind"),
        "id",
        none.cast("array<long>").alias("ids"),
        "v",
        "least",
    )
    width, axes, length = index.width, index.axes, index.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, unit = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)) for i in range(3)], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                v = _unpacked(part.column(5), width)
                if place != tuple(keys[a, :2]):
                    place, parts, unit = tuple(keys[a, :2]), [], None
                if keys[a, 2] == 0:
                    parts.append((part.column(4), v))
                    continue
                if unit is None:
                    ids = pa.chunked_array([x[0] for x in parts]).combine_chunks()
                    rows = np.concatenate([x[1] for x in parts])
                    unit, parts = Unit(ids, rows, _project(rows, axes, length)), []
                reach = length + np.einsum("ij,ij->i", v, v)
                p = _project(v, axes, None)
                names, least = np.asarray(part.column(3)), np.asarray(part.column(6))
                for i in range(0, len(names), _QUERIES):
                    block = slice(i, i + _QUERIES)
                    query, ids, scores = unit.search(v[block], p[block], names[block], k, least[block], spread, reach[block])
                    nth = np.arange(len(query)) - np.searchsorted(query, query) + 1
                    columns = [pa.array(x) for x in (names[block][query], ids, scores, nth.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "nth"])

    met = held.unionByName(asked).repartition("unit", "copy").sortWithinPartitions("unit", "copy", "kind")
    return met.select("unit", "copy", "kind", "id", "ids", "v", "least").mapInArrow(
        run, "query_id long, vec_id long, score double, nth int"
    )


def search(index: Index, queries: DataFrame, k: int | None = None, confidence: float = 0.92) -> DataFrame:
    """Return (query_id, rank, vec_id, score): for each query (id, v) the k largest inner products that it meets.

    A neighbour is missed with a chance of at most 1 - ``confidence``. Scores are the inner products of the original vectors
    in doubles, ties go to the smaller id, and the query's own id is skipped. Queries that build_index would not take are
    skipped; of queries that repeat an id the smallest vector counts. Further columns are ignored.
    """
    k = index.most if k is None else k
    if not 0 < k <= index.most:
        raise ValueError(f"this index serves up to {index.most} neighbours")
    axes, dims, cuts, low, high, length = index.axes, index.dims, index.cuts, index.low, index.high, index.length
    width, projections = index.width, axes.shape[1]
    spread = chi_square_quantile(confidence, projections)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            v = _matrix(batch.column(1), width)
            cell = pa.array(cells_of(_project(v, axes, None), dims, cuts), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), cell, _packed(v)], ["id", "cell", "v"])

    asked = _sound(queries).groupBy("id").agg(F.slice(F.min("v"), 1, width).alias("v"))
    asked = reliable_checkpoint(asked.mapInArrow(place, "id long, cell int, v binary"))

    def visits(frame: DataFrame) -> DataFrame:
        unit = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("units") - 1)).alias("unit")
        return frame.join(F.broadcast(index.cells), "cell").select(unit, "id", "v", "least")

    nearest = reliable_checkpoint(_visit(index, visits(asked.withColumn("least", F.lit(-math.inf))), k, spread))
    bounds = nearest.filter(F.col("nth") == k).groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("least"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 256):
            v = _unpacked(batch.column(2), width)
            p = _project(v, axes, None)
            own, least = np.asarray(batch.column(1)), np.asarray(batch.column(3))
            reach = length + np.einsum("ij,ij->i", v, v)
            met = []
            for i in range(len(own)):
                far = np.inf if least[i] == -np.inf else spread * max(reach[i] - 2 * least[i], 0.0)
                distance = gaps(p[i], low, high)
                cells = np.flatnonzero((distance <= far) & np.isfinite(distance))
                met.append(cells[cells != own[i]])
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in met]))), pa.int32())
            cells = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(met), pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 2, 3)], cells], ["id", "v", "least", "cells"])

    bounded = asked.join(bounds, "id", "left").select("id", "cell", "v", F.coalesce("least", F.lit(-math.inf)).alias("least"))
    rest = reliable_checkpoint(
        bounded.mapInArrow(others, "id long, v binary, least double, cells array<int>")
    )
    rest = rest.select("id", "v", "least", F.explode("cells").alias("cell"))
    found = nearest.unionByName(_visit(index, visits(rest), k, spread))
    order = win.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
