"""Exact top-k search by exhaustive term-at-a-time accumulation.

Components are terms. Candidates are dealt into blocks, queries into groups, and every pair of a group and a block is one
unit of work of bounded size. A unit turns its candidates into a posting list per term; for each term, the query rows that
hold it scatter their weighted postings into a dense score array. The best k of each row are found by partition selection
and the units' results are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as win

#: Rows of a block of candidates and of a group of queries, on average.
BLOCK_ROWS = 16_384
GROUP_ROWS = 1_024
#: Query rows and candidates of a score array that is filled at once.
_ROWS, _COLUMNS = 64, 2_048


def integer_vector(vector: Column, scale: int = 64) -> Column:
    """Return floor(scale * x) per component; null for a vector that is null or has null or non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _stack(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Return all inner products, one term at a time."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for low in range(0, len(candidates), _COLUMNS):
        block = np.ascontiguousarray(candidates[low : low + _COLUMNS].T)
        part = np.zeros((len(queries), block.shape[1]), np.int64)
        for term in range(block.shape[0]):
            rows = np.flatnonzero(queries[:, term])
            weights = queries[rows, term][:, None]
            posting = np.flatnonzero(block[term])
            if 2 * len(posting) > block.shape[1]:
                # The list covers most of the block, so its absent entries cost less as zeros than an index would.
                if len(rows) == len(queries):
                    part += weights * block[term]
                elif len(rows):
                    part[rows] += weights * block[term]
            elif len(posting) and len(rows):
                part[np.ix_(rows, posting)] += weights * block[term][posting]
        scores[:, low : low + _COLUMNS] = part
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Return the places of the k largest scores of a row, without those of id ``own``; ``ids`` ascend and break ties."""
    usable = np.flatnonzero(ids != own)
    values = scores[usable]
    if len(values) > k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        above = np.flatnonzero(values > least)
        level = np.flatnonzero(values == least)[: k - len(above)]
        usable = usable[np.concatenate((above, level))]
    return usable


_FOUND = T.StructType([T.StructField(x, T.LongType()) for x in ("query_id", "vec_id", "score")])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """Return (query_id, rank, vec_id, score): each query's k largest inner products with ``candidates``.

    Both tables are (id, v) with whole numbers; results are exact as long as they fit 64 bits. A candidate of the query's
    own id is skipped, ties go to the smaller id, and a query with fewer candidates gets all of them. Rows without an id or
    a vector take no part; of queries that repeat an id the smallest vector counts, candidates that repeat one are all
    listed. Shorter vectors count as filled up with zeros.
    """
    candidates = candidates.filter("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), "v")
    queries = queries.filter("id is not null and v is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("v").alias("v"))
    blocks = max(1, -(-candidates.count() // BLOCK_ROWS))
    groups = max(1, -(-queries.count() // GROUP_ROWS))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    asked = queries.select(
        F.lit(True).alias("query"), "id", "v", deal(groups, 1).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    held = candidates.select(
        # Rows that repeat an id are dealt apart as far as their vectors differ.
        F.lit(False).alias("query"),
        "id",
        "v",
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"),
    )

    def unit(rows: pd.DataFrame) -> pd.DataFrame:
        asked, held = rows[rows["query"]], rows[~rows["query"]].sort_values("id", kind="stable")
        out = []
        if len(asked) and len(held):
            width = max(map(len, rows["v"]))
            ids, matrix = held["id"].to_numpy(), _stack(held["v"], width)
            names, wanted = asked["id"].to_numpy(), _stack(asked["v"], width)
            for low in range(0, len(names), _ROWS):
                scores = accumulate(wanted[low : low + _ROWS], matrix)
                for i, name in enumerate(names[low : low + _ROWS]):
                    at = select(scores[i], ids, name, k)
                    out.append(pd.DataFrame({"query_id": name, "vec_id": ids[at], "score": scores[i, at]}))
        return pd.concat(out) if out else pd.DataFrame({x: pd.Series(dtype="int64") for x in ("query_id", "vec_id", "score")})

    found = asked.unionByName(held).groupBy("group", "block").applyInPandas(unit, _FOUND)
    order = win.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
