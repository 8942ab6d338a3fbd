"""Quality classifier learnt from trusted positives and unlabelled text.

A logistic model minimises the unbiased risk of positive-unlabelled learning, pi R_p(+) + R_u(-) - pi R_p(-), whose last
two terms, the risk of the unseen negatives, are kept from falling below zero: where they would, the step raises them
instead. The class prior pi is estimated from the scores of a model that tells positives from unlabelled texts. All sums run
over all training rows in Spark; only sums whose size is the square of the number of features reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaysift.llm import words as W
from assaysift.llm.memory import release
from assaysift.session import reliable_checkpoint

_CLASSES = ["lower", "upper", "digit", "blank", "line", "stop", "shout", "quote", "symbol", "bar", "control", "wide"]
_CLASS = np.full(256, _CLASSES.index("symbol"), np.uint8)
for _name, _bytes in {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "blank": b" \t",
    "line": b"\n\r\x0b\x0c",
    "stop": b".,;:",
    "shout": b"!?",
    "quote": b"'\"()-",
    "bar": b"|/\\",
    "control": [*range(0, 9), *range(14, 32), 127],
    "wide": range(128, 256),
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
_WORDS = ["log_words", "word_length", "repeated", "distinct", "commonest", "single", "odd_end", "tall", "long"]
_RAW = len(_CLASSES) + len(_WORDS)
#: Features of a text: shares and word figures, their square roots, and a constant.
N_FEATURES = 2 * _RAW + 1
_CLIP = 4.0
_RIDGE = 1e-3
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *b".,;:'\"()-", *range(128, 256)]] = True


def text_features(column: pa.Array) -> np.ndarray:
    """Return raw features of every whole text of a column; null and empty texts have zeros."""
    out = np.zeros((len(column), _RAW), np.float64)
    for row, data, offsets in W.pieces(column):
        start, end, first = W.spans(data, offsets, W.SPACED)
        hashes = W.word_hashes(data, start, end)
        kinds = _CLASS[data]
        sizes = end - start
        tall = np.concatenate(([0], np.cumsum(kinds == 1)))
        all_tall = (tall[end] - tall[start] >= 2) & (2 * (tall[end] - tall[start]) > sizes)
        odd = ~_LETTER[data[end - 1]] if len(end) else np.zeros(0, bool)
        for i in range(len(offsets) - 1):
            a, b, f, g = offsets[i], offsets[i + 1], first[i], first[i + 1]
            x = out[row + i]
            if b > a:
                x[: len(_CLASSES)] = np.bincount(kinds[a:b], minlength=len(_CLASSES)) / (b - a)
            n = g - f
            if n:
                own = np.sort(hashes[f:g])
                edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
                size = sizes[f:g]
                x[len(_CLASSES) :] = (
                    np.log1p(n) / 10,
                    min(size.mean() / 20, 1),
                    np.count_nonzero(hashes[f + 1 : g] == hashes[f : g - 1]) / n,
                    (len(edges) - 1) / n,
                    np.diff(edges).max() / n,
                    np.count_nonzero(size == 1) / n,
                    np.count_nonzero(odd[f:g]) / n,
                    np.count_nonzero(all_tall[f:g]) / n,
                    np.count_nonzero(size > 30) / n,
                )
    return np.concatenate((out, np.sqrt(out)), axis=1)


def _feature_lists(column: pa.Array) -> pa.Array:
    x = text_features(column).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Return (doc, x): raw features of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _feature_lists(batch.column(1))], ["doc", "x"])
        release()

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc long, x array<float>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _scaled(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -_CLIP, _CLIP)
    return np.concatenate((z, np.ones((len(x), 1))), axis=1)


def _sums(table: DataFrame, work, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Add up over all rows what ``work`` (features, positive flags) returns: a vector of fixed size per name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes.values()))
        for batch in batches:
            if batch.num_rows:
                found = work(_matrix(batch.column(0), 2 * _RAW), np.asarray(batch.column(1)).astype(bool))
                total += np.concatenate([np.ravel(found[k]) for k in sizes])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    rows = table.select("x", "positive").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(sum(sizes.values()))
    for row in rows:
        total[row["i"]] = row["v"]
    ends = np.cumsum(list(sizes.values()))
    return {k: total[e - sizes[k] : e] for k, e in zip(sizes, ends, strict=True)}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _step(table: DataFrame, model: dict, w: np.ndarray) -> dict[str, np.ndarray]:
    """Return the sums that one Newton step needs, of positives (p) and of all rows, which are the unlabelled ones (u)."""

    def work(x: np.ndarray, positive: np.ndarray) -> dict[str, np.ndarray]:
        x = _scaled(x, model)
        z = x @ w
        s, soft = _sigmoid(z), np.logaddexp(0, z)
        bend = s * (1 - s)
        p = positive
        return {
            "p_sum": x[p].sum(0),
            "p_up": x[p].T @ s[p],
            "u_up": x.T @ s,
            "p_bend": (x[p].T * bend[p]) @ x[p],
            "u_bend": (x.T * bend) @ x,
            "losses": np.array([np.logaddexp(0, -z[p]).sum(), soft[p].sum(), soft.sum()]),
        }

    d = N_FEATURES
    return _sums(table, work, {"p_sum": d, "p_up": d, "u_up": d, "p_bend": d * d, "u_bend": d * d, "losses": 3})


def _estimated_prior(table: DataFrame, model: dict, w: np.ndarray, n_p: float, n_u: float) -> float:
    """Return the least ratio of unlabelled to positive rows over the upper score ranges that hold half of the positives.

    No such ratio is below the true prior, and it comes down to it where negatives are rare.
    """
    bins = 200

    def work(x: np.ndarray, positive: np.ndarray) -> dict[str, np.ndarray]:
        at = np.minimum((_sigmoid(_scaled(x, model) @ w) * bins).astype(int), bins - 1)
        return {"p": np.bincount(at[positive], minlength=bins), "u": np.bincount(at, minlength=bins)}

    found = _sums(table, work, {"p": bins, "u": bins})
    above_p, above_u = np.cumsum(found["p"][::-1]) / n_p, np.cumsum(found["u"][::-1]) / n_u
    wide = above_p >= 0.5
    return float(np.clip((above_u[wide] / above_p[wide]).min(), 0.01, 0.99))


def fit(table: DataFrame, rounds: int = 10) -> dict:
    """Fit the classifier on ``table`` (x, positive): unlabelled rows are all of it, trusted positives are flagged.

    Without any positive the weights stay zero, so every text scores 0.5.
    """

    def work(x: np.ndarray, positive: np.ndarray) -> dict[str, np.ndarray]:
        return {"n": np.array([len(x), positive.sum()]), "x": x.sum(0), "xx": (x * x).sum(0)}

    found = _sums(table, work, {"n": 2, "x": 2 * _RAW, "xx": 2 * _RAW})
    n_u, n_p = found["n"]
    mean = found["x"] / max(n_u, 1)
    scale = np.sqrt(np.maximum(found["xx"] / max(n_u, 1) - mean**2, 0))
    model = {"mean": mean, "scale": np.where(scale > 1e-6, scale, 1.0), "w": np.zeros(N_FEATURES), "prior": 0.5}
    if n_p == 0:
        return model
    ridge = _RIDGE * np.eye(N_FEATURES)
    ridge[-1, -1] = 1e-9
    # Positives against unlabelled, both with weight one half, to estimate the prior; held close to zero, since the
    # positives are among the unlabelled rows too.
    w = np.zeros(N_FEATURES)
    for _ in range(max(3, rounds // 2)):
        s = _step(table, model, w)
        slope = 0.5 * (s["p_up"] - s["p_sum"]) / n_p + 0.5 * s["u_up"] / n_u + 10 * ridge @ w
        bend = 0.5 * (s["p_bend"] / n_p + s["u_bend"] / n_u).reshape(N_FEATURES, -1) + 10 * ridge
        w = w - np.linalg.solve(bend, slope)
    prior = _estimated_prior(table, model, w, n_p, n_u)
    w = np.zeros(N_FEATURES)
    best, kept, pace = np.inf, w, 1.0
    for _ in range(rounds):
        s = _step(table, model, w)
        plus, p_minus, u_minus = s["losses"][0] / n_p, s["losses"][1] / n_p, s["losses"][2] / n_u
        negative = u_minus - prior * p_minus
        risk = prior * plus + max(negative, 0.0) + 0.5 * w @ ridge @ w
        if risk < best:
            best, kept = risk, w
        elif negative >= 0:
            pace /= 2  # the last step went too far
            w = (w + kept) / 2
            continue
        bend = (s["u_bend"] / n_u).reshape(N_FEATURES, -1) + ridge
        if negative >= 0:
            slope = -prior * s["p_sum"] / n_p + s["u_up"] / n_u + ridge @ w
            w = w - pace * np.linalg.solve(bend, slope)
        else:
            # Below zero the risk of negatives is noise; a step against its slope brings it back.
            slope = s["u_up"] / n_u - prior * s["p_up"] / n_p
            w = w + 0.1 * pace * np.linalg.solve(bend + ridge, slope)
    return model | {"w": kept, "prior": prior}


def _held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(features: DataFrame, labels: DataFrame) -> dict:
    """Fit on ``features`` (doc, x) and the trusted positives of ``labels`` (doc_id, quality), without held-out ids.

    An id is positive if any of its labels is 1; null ids and labels count for nothing. Held out are ids whose CRC-32 as
    text leaves 1 when divided by 3: they are neither positives nor unlabelled rows.
    """
    positive = (
        labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("quality").alias("quality"))
        .filter((F.col("quality") == 1) & F.col("doc").isNotNull() & ~_held_out(F.col("doc")))
        .select("doc", F.lit(True).alias("positive"))
        .distinct()
    )
    table = features.filter(~_held_out(F.col("doc"))).join(positive, "doc", "left")
    return fit(reliable_checkpoint(table.select("x", F.coalesce("positive", F.lit(False)).alias("positive"))))


def _features_of(text: Column) -> Column:
    """Return the raw features of a text column, taken from Arrow data a piece at a time."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def features(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield _feature_lists(column)
        release()

    return features(text)


def _score_of(model: dict, x: Column) -> Column:
    """Return the score of raw features under a fitted model."""

    @F.arrow_udf(T.DoubleType())
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(_sigmoid(_scaled(_matrix(column, 2 * _RAW), model) @ model["w"]))

    return score(x)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (doc_id, held_out, score, predicted) for every row of ``docs``; scores depend on whole texts alone.

    Null and empty texts share one score. Rows may repeat or lack an id; further columns are ignored.
    """
    features = reliable_checkpoint(feature_table(docs, id_col, text_col))
    model = train(features, labels)

    scored = features.select("doc", _score_of(model, F.col("x")).alias("score"))
    return scored.select(
        F.col("doc").alias("doc_id"), _held_out(F.col("doc")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def reject_low_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Return the rows of ``docs`` (doc_id, text, ...) whose score is ``least`` or more, unchanged."""
    x = "__x"
    while x in docs.columns:
        x += "_"
    # Rows are stored with their features, so every text is read by Python once.
    stored = reliable_checkpoint(docs.withColumn(x, _features_of(F.col("text").cast("string"))))
    model = train(stored.select(F.col("doc_id").cast("long").alias("doc"), F.col(x).alias("x")), labels)
    return stored.filter(_score_of(model, F.col(x)) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
