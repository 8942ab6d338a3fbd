import numpy as np
import pandas as pd
import pytest
from conftest import pdf
from pyspark.sql import functions as F

from assaysift.functions import ordering as o


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 3000
    data = pd.DataFrame(
        {
            "row": np.arange(n),
            "g": rng.choice(["a", "b", "c"], size=n, p=[0.7, 0.25, 0.05]),
            # a third of all rows share one value
            "v": np.where(rng.random(n) < 0.34, 1.5, np.round(rng.normal(size=n), 2)),
        }
    )
    data.loc[data.index % 37 == 0, "v"] = np.nan
    data.loc[n] = [n, "d", np.nan]
    data["row"] = data["row"].astype("int64")
    return data, spark.createDataFrame(data)


@pytest.mark.parametrize("strategy", ["window", "split"])
def test_percent_rank_matches_pandas(frame, strategy, monkeypatch):
    monkeypatch.setattr(o, "COPY_ROWS", 100)  # make the heavy value take the replicated path
    data, df = frame
    got = pdf(o.percent_rank_average(df, ["g"], "v", "r", strategy), "row")
    expected = data.groupby("g")["v"].rank(method="average", pct=True)
    assert len(got) == len(data)
    np.testing.assert_array_equal(got["r"].to_numpy(float), expected.to_numpy(float))


@pytest.mark.parametrize("group", [["g"], []])
def test_ranks_across_many_slots(spark, frame, group):
    """A value of a third of all rows, some of them identical, lies in several slots."""
    data, df = frame
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = pdf(o.average_rank(df, group, "v", "r", "n"), "row")
        known = df.select("g", "v").where("v IS NOT NULL AND NOT isnan(v)")
        pairs = o.pair_ranks(known, group, {"v": "r"}).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = data.groupby("g")["v"] if group else data["v"]
    np.testing.assert_array_equal(got["r"].to_numpy(float), whole.rank(method="average").to_numpy(float))
    count = whole.transform("count") if group else pd.Series(data["v"].count(), index=data.index)
    np.testing.assert_array_equal(got["n"], count)
    clean = data.dropna()
    expected = (clean.groupby("g")["v"] if group else clean["v"]).rank(method="average")
    np.testing.assert_array_equal(np.sort(pairs["r"]), np.sort(expected))


@pytest.mark.parametrize("strategy", ["window", "split"])
def test_row_positions(frame, strategy):
    data, df = frame
    got = pdf(o.row_positions(df.where("v IS NOT NULL"), ["g"], [("v", False), ("row", True)], "pos", "n", strategy), "row")
    clean = data.dropna().copy()
    ordered = clean.sort_values(["v", "row"], ascending=[False, True])
    expected = (ordered.groupby("g").cumcount() + 1).sort_index()
    np.testing.assert_array_equal(got["pos"], expected)
    np.testing.assert_array_equal(got["n"], clean.groupby("g")["row"].transform("count"))


@pytest.mark.parametrize("strategy", ["window", "split"])
def test_quantiles(frame, strategy):
    data, df = frame
    probs = {"q10": 0.1, "q50": 0.5, "q93": 0.93, "q100": 1.0}
    got = pdf(o.quantiles(df, ["g"], "v", probs, strategy), "g")
    for name, p in probs.items():
        np.testing.assert_allclose(got[name], data.dropna().groupby("g")["v"].quantile(p), rtol=1e-14)
    whole = o.exact_quantile(df, "v", 0.3, strategy)
    assert whole == pytest.approx(data["v"].quantile(0.3), rel=1e-14)


@pytest.mark.parametrize("strategy", ["window", "split"])
def test_prefix_totals_ungrouped(frame, strategy):
    data, df = frame
    totals = o.prefix_totals(df.where("v IS NOT NULL"), [], ["v"], {"s": F.col("row")}, strategy)
    got = pdf(totals, "v")
    clean = data.dropna()
    per = clean.groupby("v")["row"].agg(["size", "sum"])
    np.testing.assert_array_equal(got["n_before"], per["size"].cumsum() - per["size"])
    np.testing.assert_array_equal(got["s_before"], per["sum"].cumsum() - per["sum"])
    assert set(got["n_total"]) == {len(clean)}


def test_split_plan_never_windows_over_the_bare_group(frame):
    _, df = frame
    plan = o.row_positions(df, ["g"], [("row", True)], "pos", strategy="split")._jdf.queryExecution().optimizedPlan()
    windows = [line for line in plan.toString().splitlines() if line.strip(" :+-").startswith("Window")]
    assert windows and any("__slot" in line for line in windows)
