"""Boosted trees against a plain implementation on whole arrays."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaysift.operators import boosting, models, tuning

NAMES = ["a", "b", "c-d"]


def _table(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 5, n) * 2.5, rng.integers(-3, 4, n)]).astype(float)
    x[rng.random((n, 3)) < 0.15] = np.nan
    y = np.nan_to_num(x[:, 0], nan=9) * 0.7 - np.nan_to_num(x[:, 1], nan=-4) + rng.normal(size=n)
    w = rng.integers(0, 3, (n, 2)).astype(float)
    frame = pd.DataFrame(x, columns=NAMES).assign(y=y, fold=np.arange(n) % 3, w=w.tolist(), id=np.arange(n))
    return frame, x, y, w


def _plain(x, y, w, params, feature_sets=None):
    """Return margins and the splits of every tree, by trying every value of every feature."""
    alpha, lam, least = params.get("reg_alpha", 0.0), params.get("reg_lambda", 1.0), params.get("min_child_weight", 1.0)

    def soft(g):
        return np.sign(g) * max(abs(g) - alpha, 0)

    def quality(g, h):
        return soft(g) ** 2 / (h + lam) if h + lam else 0.0

    margin, splits = np.full(len(y), (w * y).sum() / w.sum()), []
    for _ in range(params["n_estimators"]):
        g, h, own = w * (margin - y), w, {}
        parts = {0: np.arange(len(y))}
        for level in range(params["max_depth"] + 1):
            for node in [k for k in parts if 2**level - 1 <= k < 2 ** (level + 1) - 1]:
                rows = parts[node]
                margin[rows] = margin[rows]  # leaves are added below
                best = (1e-6, None)
                if level < params["max_depth"]:
                    for f in range(x.shape[1]):
                        for cut in np.unique(x[~np.isnan(x[:, f]), f]):
                            for missing in (False, True):
                                left = np.where(np.isnan(x[rows, f]), missing, x[rows, f] <= cut)
                                a, b = rows[left], rows[~left]
                                if h[a].sum() < max(least, 1e-12) or h[b].sum() < max(least, 1e-12):
                                    continue
                                gain = quality(g[a].sum(), h[a].sum()) + quality(g[b].sum(), h[b].sum()) - quality(g[rows].sum(), h[rows].sum())
                                if gain > best[0] + 1e-9:
                                    best = (gain, (f, cut, missing, a, b))
                if best[1] is None:
                    own[node] = (None, -soft(g[rows].sum()) / (h[rows].sum() + lam) * params["learning_rate"], rows)
                else:
                    f, cut, missing, a, b = best[1]
                    own[node] = ((f, cut, missing), None, rows)
                    parts[2 * node + 1], parts[2 * node + 2] = a, b
        for split, value, rows in own.values():
            if split is None:
                margin[rows] += value
        splits.append({k: v[0] for k, v in own.items()})
    return margin, splits


@pytest.mark.parametrize(
    "params",
    [
        {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0},
        {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "reg_alpha": 5.0, "reg_lambda": 20.0},
        {"n_estimators": 2, "max_depth": 4, "learning_rate": 0.5, "reg_lambda": 0.0, "min_child_weight": 12.0},
        {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.5, "reg_alpha": 1e6},
    ],
)
def test_trees_equal_the_plain_version(spark, params):
    frame, x, y, w = _table()
    df = spark.createDataFrame(frame).repartition(3)
    fits = [boosting.TreeFit(params), boosting.TreeFit(params, 1), boosting.TreeFit(params, None, 1), boosting.TreeFit(params, 2, 0)]
    weights = [np.ones(len(y)), (frame["fold"] != 1) * 1.0, w[:, 1], w[:, 0] * (frame["fold"] != 2)]
    fitted = boosting.fit_many(df, NAMES, "y", fits, "fold", "w")
    got = df.select("id", boosting.predictions(fitted).alias("p")).toPandas().sort_values("id")
    for i, weight in enumerate(weights):
        margin, splits = _plain(x, y, np.asarray(weight, float), params)
        for tree, plain in zip(fitted[i].trees, splits, strict=True):
            for node, split in plain.items():
                if split is None:
                    assert tree.feature[node] == -1
                else:
                    f = tree.feature[node]
                    assert (f, fitted[i].cuts[f][tree.bin[node]]) == split[:2]
        np.testing.assert_allclose(np.stack(got["p"])[:, i], margin, rtol=1e-9, atol=1e-9)


def test_stored_predictions_and_fits_of_unequal_length(spark, monkeypatch):
    frame, x, y, _ = _table(150, 3)
    df = spark.createDataFrame(frame)
    monkeypatch.setattr(boosting, "KEEP_TREES", 2)
    params = [{"n_estimators": n, "max_depth": d, "learning_rate": 0.4} for n, d in ((5, 2), (1, 1), (0, 2))]
    fitted = boosting.fit_many(df, NAMES, "y", [boosting.TreeFit(p) for p in params])
    got = np.stack(df.select("id", boosting.predictions(fitted).alias("p")).toPandas().sort_values("id")["p"])
    for i, p in enumerate(params):
        np.testing.assert_allclose(got[:, i], _plain(x, y, np.ones(len(y)), p)[0], rtol=1e-9)


def test_many_values_are_cut_along_quantiles(spark):
    frame = pd.DataFrame({"a": np.arange(5000.0), "b": np.r_[np.zeros(4999), 1.0], "c-d": np.nan})
    cuts = boosting.feature_cuts(spark.createDataFrame(frame), NAMES, 16)
    assert len(cuts[0]) == 16 and np.abs(np.diff(cuts[0]) - 312.5).max() <= 5
    assert cuts[1].tolist() == [0.0, 1.0] and len(cuts[2]) == 0


def test_penalties_samples_and_missing_values_through_models(spark):
    frame, x, y, w = _table(300, 5)
    df = spark.createDataFrame(frame).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    base = {"n_estimators": 4, "max_depth": 2, "learning_rate": 0.5, "subsample": 0.6, "colsample_bytree": 0.7}
    one, two = (models.fit(df, "xgboost", NAMES, "y", base | {"random_state": s}) for s in (1, 1))
    scored = models.predict(two, models.predict(one, df, "p"), "q").toPandas()
    assert (scored["p"] == scored["q"]).all() and ((scored["p"] - scored["y"]) ** 2).mean() < scored["y"].var()
    other = models.predict(models.fit(df, "xgboost", NAMES, "y", base | {"random_state": 2}), df, "p").toPandas()
    assert not np.allclose(other.sort_values("id")["p"], scored.sort_values("id")["p"])
    flat = models.predict(models.fit(df, "xgboost", NAMES, "y", {"reg_alpha": 1e9, "n_estimators": 2}), df, "p").toPandas()
    np.testing.assert_allclose(flat["p"], y.mean())
    members = models.fit_ensemble(df, "xgboost", NAMES, "y", {"n_estimators": 2, "subsample": 1.0, "colsample_bytree": 1.0, "max_depth": 2}, False, "w", 2)
    pair = models.predict_ensemble(members, df, "m", "s").toPandas().sort_values("id")
    sides = [_plain(x, y, w[:, b], {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.05})[0] for b in range(2)]
    np.testing.assert_allclose(pair["m"], np.mean(sides, axis=0), rtol=1e-9)
    np.testing.assert_allclose(pair["s"], np.std(sides, axis=0, ddof=1), rtol=1e-6, atol=1e-9)
    with pytest.raises(ValueError, match="squared"):
        models.fit(df, "xgboost", NAMES, "y", {"objective": "rank:pairwise"})


def test_no_rows(spark):
    frame, *_ = _table(10)
    none = spark.createDataFrame(frame).filter("id < 0")
    model = models.fit(none, "xgboost", NAMES, "y", {"n_estimators": 2})
    assert models.predict(model, spark.createDataFrame(frame), "p").agg(F.max(F.abs("p"))).first()[0] == 0


@pytest.mark.parametrize("metric", ["rmse", "spearman"])
def test_tree_trials_score_as_single_fits(spark, metric):
    frame, *_ = _table(200, 8)
    df = spark.createDataFrame(frame).withColumn("fold", F.when(F.col("id") >= 12, F.col("fold")))
    trials = [{"n_estimators": 2, "max_depth": 2, "subsample": 1.0, "colsample_bytree": 1.0, "learning_rate": r} for r in (0.1, 0.6)]
    found = tuning.score_tree_trials(df, "fold", NAMES, "y", trials, metric, {})
    single = [tuning.score_params(df, "fold", NAMES, "y", "xgboost", p, False, metric, {}) for p in trials]
    np.testing.assert_allclose(found, single, rtol=1e-9)


def test_cuts_do_not_depend_on_how_rows_lie(spark):
    """Bins of a feature of many values end at exact quantiles, however rows are dealt to tasks."""
    n, bins = 60_000, 256
    x = np.random.default_rng(4).normal(size=n).round(5)
    df = spark.createDataFrame(pd.DataFrame({"x": np.append(x, np.nan), "few": np.arange(n + 1) % 7}))
    want = np.unique(np.sort(x)[[-(-k * n // bins) - 1 for k in range(1, bins + 1)]])
    for rows in (df, df.repartition(13, "x"), df.orderBy("x"), df.orderBy(F.hash("x")).coalesce(3)):
        cuts = boosting.feature_cuts(rows, ["x", "few"], bins)
        np.testing.assert_array_equal(cuts[0], want)
        np.testing.assert_array_equal(cuts[1], np.arange(7.0))


def test_passes_read_blocks_and_leave_nothing_behind(spark, monkeypatch):
    """A pass over the rows hands Spark a record per thousands of rows; what a fit has stored goes with it."""
    n, stored, keep = 20_000, [], boosting.reliable_checkpoint

    def counted(df, **options):
        stored.append(keep(df, **options))
        sizes.append(stored[-1].count())
        return stored[-1]

    sizes: list[int] = []
    monkeypatch.setattr(boosting, "reliable_checkpoint", counted)
    monkeypatch.setattr(boosting, "KEEP_TREES", 1)
    rng = np.random.default_rng(6)
    x, w = rng.integers(0, 900, n).astype(float), rng.integers(0, 3, n).astype(float)
    y = np.where(x < 300, 1.0, 5.0) + rng.normal(size=n)
    frame = pd.DataFrame({"x": x, "y": y, "w": [[None if k % 7 == 0 else v, None] for k, v in enumerate(w)]})
    df = spark.createDataFrame(frame, "x double, y double, w array<double>").repartition(3)
    params = {"n_estimators": 2, "max_depth": 1, "learning_rate": 1.0, "reg_lambda": 0.0}
    plain, weighted = boosting.fit_many(df, ["x"], "y", [boosting.TreeFit(params), boosting.TreeFit(params, None, 0)], None, "w", 30)
    assert sizes and max(sizes) < n / 50
    for weight, model in ((np.ones(n), plain), (np.where(np.arange(n) % 7 == 0, 0.0, w), weighted)):
        tree, cut = model.trees[0], model.cuts[0][model.trees[0].bin[0]]
        base = (weight * y).sum() / weight.sum()
        assert abs(cut - 300) < 31 and abs(model.base - base) < 1e-9
        left = (weight * y)[x <= cut].sum() / weight[x <= cut].sum()
        assert abs(base + tree.value[1] - left) < 1e-9
    for table in stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(table._assaysift_path)
        assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


@pytest.mark.parametrize("listed", [0, 200])
def test_quantiles_of_odd_values_are_exact(spark, monkeypatch, listed):
    """Cells are cut down to single values, or to few rows that are listed, whatever the values' range and repeats."""
    monkeypatch.setattr(boosting, "LISTED_ROWS", listed)
    monkeypatch.setattr(boosting, "MAX_COUNTERS", 1 << 10)
    rng, bins = np.random.default_rng(9), 16
    wide = rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000)
    odd = [np.inf, -np.inf, -0.0, 0.0, 5e-324, -5e-324, 1.7976931348623157e308, np.nan, np.nan]
    columns = {
        "wide": np.r_[wide, np.full(900, 7.25), odd, np.zeros(1091)],
        "near": 1.0 + np.arange(5000) * 2.0**-52,
        "most": np.where(rng.random(5000) < 0.9, -0.0, rng.normal(size=5000)),
        "few": np.arange(5000) % 16 - 0.5,
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(4)
    for name, cuts in zip(columns, boosting.feature_cuts(df, list(columns), bins), strict=True):
        known = np.sort(columns[name][~np.isnan(columns[name])])
        ends = known[[-(-k * len(known) // bins) - 1 for k in range(1, bins + 1)]]
        np.testing.assert_array_equal(cuts, np.unique(known if name == "few" else ends))
