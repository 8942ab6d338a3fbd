import hashlib

import numpy as np
import pandas as pd
import pytest
from conftest import pdf
from pyspark.sql import functions as F

from assaysift.functions import params as par
from assaysift.operators import bins, conformal, linear, metrics, models, oof, pairs, selection, splits, trials


@pytest.mark.parametrize("strategy", ["window", "split"])
def test_quantile_bins_match_pandas(spark, strategy):
    rng = np.random.default_rng(0)
    sizes = {"a": 12, "b": 4, "c": 1, "d": 57, "e": 101}
    data = pd.concat([pd.DataFrame({"g": g, "v": np.round(rng.normal(size=n), 1)}) for g, n in sizes.items()], ignore_index=True)
    data.loc[len(data)] = ["d", np.nan]
    data["row"] = np.arange(len(data))

    def cut(values):
        known = values.dropna()
        q = min(10, len(known), known.nunique())
        out = pd.Series(np.nan, index=values.index)
        out[known.index] = 1 if q <= 1 else pd.qcut(known.rank(method="first"), q, labels=False) + 1
        return out

    df = spark.createDataFrame(data)
    got = pdf(bins.quantile_bins(df, ["g"], "v", ["row"], "bin", limit_to_distinct=True, strategy=strategy), "row")
    expected = data.groupby("g")["v"].transform(cut)
    np.testing.assert_array_equal(got["bin"].to_numpy(float), expected.to_numpy(float))


def test_regression_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    n = 400
    data = pd.DataFrame({"id": np.arange(n), "fold": np.arange(n) % 3, "y": np.round(rng.normal(5, 1, n), 1)})
    data["p"] = data["y"] + rng.normal(size=n)
    data.loc[n] = [n, 9, 4.0, 4.0]
    data.loc[n + 1] = [n + 1, 9, 4.0, 4.5]
    data = data.astype({"id": "int64", "fold": "int64"})
    got = pdf(
        metrics.regression_metrics(spark.createDataFrame(data), ["fold"], "y", "p", 6.0, [0.01, 0.05], [10, 500], ["id"]), "fold"
    )
    for i, (_, g) in enumerate(data.groupby("fold")):
        row = got.iloc[i]
        error = g["y"] - g["p"]
        assert row["rmse"] == pytest.approx(np.sqrt((error**2).mean()))
        if g["y"].nunique() == 1:
            assert row["r2"] == 0.0 and np.isnan(row["spearman"]) and np.isnan(row["ef_1pct"])
            assert row["precision_at_10"] == 0.0
            continue
        assert row["r2"] == pytest.approx(1 - (error**2).sum() / ((g["y"] - g["y"].mean()) ** 2).sum())
        assert row["spearman"] == pytest.approx(g["y"].rank().corr(g["p"].rank()))
        hits = (g["y"] >= 6.0).astype(int)
        ordered = hits[g.sort_values(["p", "id"], ascending=[False, True]).index]
        k = int(np.ceil(len(g) * 0.05))
        assert row["ef_5pct"] == pytest.approx(ordered.head(k).mean() / hits.mean())
        assert row["precision_at_10"] == pytest.approx(ordered.head(10).mean())
        assert row["precision_at_500"] == pytest.approx(hits.mean())


def test_metric_names_and_directions():
    assert metrics.enrichment_name(0.01) == "ef_1pct" and metrics.enrichment_name(0.025) == "ef_2p5pct"
    assert metrics.higher_is_better("r2") and metrics.higher_is_better("ef_1pct") and not metrics.higher_is_better("rmse")
    with pytest.raises(ValueError):
        metrics.top_k(F.lit(1), 0.0)


def _md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def test_random_assignments_follow_the_keyed_digest(spark):
    n = 53
    df = splits.with_row_pos(spark.range(n).withColumnRenamed("id", "k"), ["k"])
    got = pdf(splits.random_kfold(df, 5, True, 42), "row_pos")
    order, start = sorted(range(n), key=lambda i: _md5(42, i)), 0
    for fold, size in enumerate([11, 11, 11, 10, 10]):
        assert set(got.loc[got["fold"] == fold, "row_pos"]) == set(order[start : start + size])
        start += size
    held = pdf(splits.random_holdout(df, 0.2, 43), "row_pos")
    assert set(held.loc[held["is_test"], "row_pos"]) == set(sorted(range(n), key=lambda i: _md5(43, i))[:11])
    weights = pdf(splits.bootstrap_weights(df, 3, 7), "row_pos")
    for b in range(3):
        drawn = [int(_md5(7, b, i)[:13], 16) / 2**52 * n for i in range(n)]
        assert [w[b] for w in weights["weights"]] == list(np.bincount(np.array(drawn, int), minlength=n))


def test_missing_group_is_a_group_of_its_own(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(4)], "g string, i int")
    got = pdf(splits.group_kfold(df, "g", 3))
    assert sorted(got["fold"].value_counts()) == [4, 4, 4] and got.loc[got["g"].isna(), "fold"].nunique() == 1


def test_unknown_spread_and_label_stay_unknown(spark):
    row = spark.sql("SELECT CAST(NULL AS DOUBLE) s, 0D z, CAST('NaN' AS DOUBLE) l").select(
        conformal.safe_spread(F.col("s")).alias("s"), conformal.safe_spread(F.col("z")).alias("z"), metrics.hit(F.col("l"), 5.0).alias("h")
    ).first()
    assert row["s"] is None and row["z"] == 1e-6 and row["h"] == 0


@pytest.mark.parametrize("k", [2, 3, 7])
def test_runs_are_the_greedy_assignment(k):
    """Runs of a size and group-by-group balancing agree, with hot groups and many equal ones."""
    rng = np.random.default_rng(k)
    for _ in range(60):
        sizes = [(int(s), int(c)) for s, c in zip(rng.choice(200, 6, replace=False) + 1, rng.integers(1, 40, 6), strict=True)]
        sizes += [(5000, 1), (1 + 300, 2)]
        loads, expected = [0] * k, []
        for size, count in sorted(sizes, reverse=True):
            for at in range(count):
                fold = loads.index(min(loads))
                loads[fold] += size
                expected.append((size, at, fold))
        got = [
            (size, at, turn[(at - start) % len(turn)])
            for size, start, end, turn in splits.greedy_runs(sizes, k)
            for at in range(start, end)
        ]
        assert got == expected


def test_value_bins_follow_quantiles_of_values(spark):
    """As pandas' qcut with duplicate edges dropped; missing values stay missing."""
    values = [0.1] * 9 + [0.2, 0.3, 0.3, 0.7, 0.9, 1.4, 2.0, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = pdf(bins.value_bins(df, "v", "b", 10), "i")
    expected = pd.qcut(pd.Series(values, dtype=float), 10, labels=False, duplicates="drop")
    np.testing.assert_array_equal(got["b"].to_numpy(float), expected.to_numpy(float))


def test_groups_are_never_split(spark):
    df = spark.createDataFrame([(g, i) for g, n in zip("abcdef", [9, 7, 5, 3, 2, 2], strict=True) for i in range(n)], "g string, i int")
    got = pdf(splits.group_kfold(df, "g", 3))
    assert (got.groupby("g")["fold"].nunique() == 1).all()
    assert sorted(got["fold"].value_counts()) == [9, 9, 10]
    with pytest.raises(ValueError):
        splits.make_folds(df, "unknown")


@pytest.mark.parametrize("p", [3, 12])
def test_ridge_matches_direct_solution(spark, p, monkeypatch):
    rng = np.random.default_rng(p)
    n = 200
    x = rng.normal(loc=50, scale=3, size=(n, p))
    x[:, 1] = 7.0  # no spread
    y = x @ rng.normal(size=p) + rng.normal(size=n)
    weights = rng.integers(0, 4, size=(n, 2))
    names = [f"f-{i}" for i in range(p)]
    frame = pd.DataFrame(x, columns=names).assign(y=y, fold=np.arange(n) % 2, w=weights.tolist())
    df = spark.createDataFrame(frame)
    stats = linear.moments(df, names, "y", ["fold"], "w", 2)
    total = stats[(0,)][1].matrix + stats[(1,)][1].matrix
    whole = linear.Moments(total, stats[(0,)][1].shift, n)
    model = linear.solve_ridge(whole, names, [12.5], standardize=True)[0]
    w = weights[:, 1].astype(float)
    mean = (w[:, None] * x).sum(0) / w.sum()
    scale = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum())
    scale[scale < 1e-12] = 1.0
    z = (x - mean) / scale
    y_mean = (w * y).sum() / w.sum()
    beta = np.linalg.solve((z * w[:, None]).T @ z + 12.5 * np.eye(p), (z * w[:, None]).T @ (y - y_mean))
    np.testing.assert_allclose(model.coefficients, beta / scale, rtol=1e-7, atol=1e-9)
    got = df.select(model.column().alias("p")).toPandas()["p"]
    np.testing.assert_allclose(np.sort(got), np.sort(z @ beta + y_mean), rtol=1e-9)


def test_incomplete_rows_are_refused(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0)], "x double, y double")
    with pytest.raises(ValueError, match="complete rows"):
        linear.moments(df, ["x"], "y")


def test_gaussian_process_matches_dense_algebra(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2))
    y = np.sin(x[:, 0]) + x[:, 1]
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    model = models.fit(df, "gp", ["a", "b"], "y")
    got = models.predict(model, df, "m", "s").toPandas()
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    dual = np.linalg.solve(kernel + 1e-6 * np.eye(40), (y - y.mean()) / y.std())
    np.testing.assert_allclose(np.sort(got["m"]), np.sort(kernel @ dual * y.std() + y.mean()), atol=1e-4)
    assert (got["s"] >= 0).all() and models.search_space("gp") == {}
    with pytest.raises(ValueError):
        models.resolve_model("forest")


def test_conformal(spark):
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"y": rng.normal(size=101), "m": 0.0, "s": np.where(np.arange(101) % 5 == 0, 0.0, 1.0)})
    df = spark.createDataFrame(data)
    z = data["y"].abs() / data["s"].clip(lower=1e-6)
    q = conformal.fit_multiplier(df, "y", "m", "s", 0.9).first()[0]
    assert q == pytest.approx(np.quantile(z, 0.9))
    found = conformal.calibration_errors(df, "y", "m", "s", 0.9)
    assert found["standardized_err_median"] == pytest.approx(np.median(z))
    rows = df.withColumn("id", F.monotonically_increasing_id()).withColumnsRenamed({"y": "label_pkd", "m": "pred_mean"})
    out = oof.add_prediction_columns(rows.withColumn("pred_err", F.when(F.col("s") > 0, 1.0))).toPandas()
    assert out["covered"].isna().sum() == (data["s"] == 0).sum()
    with pytest.raises(ValueError):
        conformal.fit_multiplier(df, "y", "m", "s", 1.0)


def test_selection_rules(spark):
    rows = []
    for name, model, p, scores in [
        ("big", "xgboost", 20, [0.90, 0.92, 0.94]),
        ("small", "xgboost", 6, [0.90, 0.91, 0.93]),
        ("small", "ridge", 6, [0.90, 0.91, 0.93]),
        ("weak", "ridge", 2, [0.1, 0.2, 0.3]),
    ]:
        rows += [("d", k, name, model, p, s) for k, s in enumerate(scores)]
    rows.append(("d", 3, "big", "xgboost", 20, None))
    df = spark.createDataFrame(rows, "dataset_label string, outer_fold int, comparison_name string, model_type string, p int, spearman double")
    best = selection.official_candidate(selection.select_candidates(df, "spearman"))
    assert (best.comparison_name, best.model_type) == ("small", "ridge")
    assert best.record["one_se_eligible_count"] == 3
    assert selection.official_candidate(selection.select_candidates(df, "spearman", "best_mean")).comparison_name == "big"
    with pytest.raises(ValueError):
        selection.select_candidates(df, "spearman", "coin")
    winners = pdf(selection.fold_winners(df), "outer_fold")
    assert list(winners["winner_label"]) == ["ridge | small", "xgboost | big", "xgboost | big"]


def test_params_round_trip(spark):
    values = {"alpha": 12.3456, "n_estimators": 100, "subsample": 0.5, "kind": "x", "none": None, "flag": True}
    text = par.format_params(values)
    assert text == "{'alpha': 12.3, 'flag': True, 'kind': 'x', 'n_estimators': 100, 'none': None, 'subsample': 0.5}"
    assert par.parse_params(text)["alpha"] == 12.3 and par.parse_params(None) == {} and par.format_params({}) == "{}"
    with pytest.raises(ValueError):
        par.parse_params("[1]")
    df = spark.createDataFrame([(text,), ("{}",)], "model_params string")
    got = pdf(par.expand_params(df), "param_signature")
    assert got["param_kind"].tolist() == [None, "x"] and got["param_log10_alpha"][1] == pytest.approx(np.log10(12.3))
    assert got["param_signature"][1].startswith("alpha=12.3;flag=true;kind=x")


def test_bin_texts(spark):
    values = [0.8125, 3.0, -2.25, 123.456, 1234.56, 0.00012345, 0.05, 99.96, 100.4]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r[0] for r in df.select(trials.bin_number_text(F.col("v"))).collect()]
    assert got == [f"{v:.3g}" for v in values]


@pytest.mark.parametrize("strategy", ["window", "split"])
def test_triplets_and_pairs(spark, strategy):
    rows = []
    values = {"c1": (5.0, 5.0, 6.0), "c2": (7.0, 4.0, 5.0), "c3": (5.0, None, 5.0)}
    for key, labels in values.items():
        for target, label in zip(("pa_ph1n1", "pa_h3n2", "pa_h5n1"), labels, strict=True):
            if label is not None:
                rows.append(("pa", key, target, label, label + 0.5, -0.5, 0.5, 1))
    kinds = "dataset_label string, id string, target string, label_pkd double, pred_mean double, residual double, abs_error double, outer_fold int"
    df = spark.createDataFrame(rows, kinds)
    triplets = pdf(pairs.oof_triplets(df, strategy=strategy), "heatmap_row")
    assert list(triplets["id"]) == ["c2", "c1"]  # equal means: wider range first
    assert list(triplets["observed_worst_strain"]) == ["h3n2", "ph1n1"]  # ties go to the earlier strain
    found = pdf(pairs.target_pairs(df), "id", "strain_pair")
    assert len(found) == 7 and found["delta_residual"].abs().max() == 0
    single = df.where("target <> 'pa_h5n1'")
    assert pairs.target_pairs(single).count() == 0  # a class with an unseen target is left out
    final = pairs.final_triplets(df.select("dataset_label", "id", "target", "pred_mean", F.lit(0).alias("in_experimental_data")))
    # equal means and middles: the higher best prediction comes first
    profile = pdf(pairs.unassayed_profile(final, strategy), "unassayed_prediction_rank")
    assert list(profile["id"]) == ["c2", "c1"]
    summary = pdf(pairs.pair_summary(df, pairs.target_pairs(df), pairs.oof_triplets(df), final))
    assert summary["oof_compounds"][0] == 3 and summary["complete_oof_triplets"][0] == 2


@pytest.mark.parametrize("p", [3, 12])
def test_closed_form_fold_scores_equal_scored_rows(spark, p):
    """Against predictions of every row, with resampling weights, constant labels, a fold of one row and rows without a fold."""
    rng = np.random.default_rng(p)
    n = 240
    x = rng.normal(size=(n, p)) * rng.uniform(0.1, 50, p) + 7
    y = x @ rng.normal(size=p) + rng.normal(size=n)
    fold = np.where(np.arange(n) < 20, 9.0, np.arange(n) % 3)
    fold[-1], fold[-5:-2] = 8.0, np.nan
    y[fold == 9.0] = 4.0
    weights = rng.integers(0, 3, size=(n, 2))
    names = [f"f{i}" for i in range(p)]
    frame = pd.DataFrame(x, columns=names).assign(y=y, w=weights.tolist(), fold=fold)
    df = spark.createDataFrame(frame).withColumn("fold", F.when(~F.isnan("fold"), F.col("fold").cast("int")))
    found = {(f, b, i): (rmse, r2) for f, b, i, rmse, r2 in linear.fold_scores(linear.moments(df, names, "y", ["fold"], "w", 2), names, [0.5, 30.0], True)}
    for b in range(2):
        w = weights[:, b].astype(float)
        for k in (0, 1, 2, 8, 9):
            train, held = fold != k, fold == k
            if not w[held].sum():
                assert (k, b, 0) not in found
                continue
            mean = np.average(x[train], axis=0, weights=w[train])
            scale = np.sqrt(np.average((x[train] - mean) ** 2, axis=0, weights=w[train]))
            z, y_mean = (x - mean) / scale, np.average(y[train], weights=w[train])
            for i, alpha in enumerate((0.5, 30.0)):
                a = (z[train] * w[train, None]).T @ z[train] + alpha * np.eye(p)
                beta = np.linalg.solve(a, (z[train] * w[train, None]).T @ (y[train] - y_mean))
                error = (w * (y - y_mean - z @ beta) ** 2)[held].sum()
                rmse, r2 = found[(k, b, i)]
                assert rmse == pytest.approx(np.sqrt(error / w[held].sum()), rel=1e-7)
                if w[held].sum() < 2:
                    assert r2 is None
                elif np.ptp(y[held & (w > 0)]) == 0:
                    assert r2 == 0.0
                else:
                    spread = (w * (y - np.average(y[held], weights=w[held])) ** 2)[held].sum()
                    assert r2 == pytest.approx(1 - error / spread, rel=1e-6, abs=1e-6)


def test_only_one_metric_makes_no_other_ordering(spark):
    data = pd.DataFrame({"fold": [0] * 5 + [1] * 5, "y": np.arange(10.0) ** 2, "p": [1, 0, 3, 2, 4, 9, 8, 5, 6, 7], "id": range(10)})
    df = spark.createDataFrame(data)
    full = pdf(metrics.regression_metrics(df, ["fold"], "y", "p", 6.0, [0.2], [2], ["id"]), "fold")
    for name in ("rmse", "mae", "r2", "spearman", "ef_20pct", "precision_at_2"):
        one = pdf(metrics.regression_metrics(df, ["fold"], "y", "p", 6.0, [0.2], [2], ["id"], only=name), "fold")
        np.testing.assert_allclose(one[name], full[name])
