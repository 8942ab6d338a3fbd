import numpy as np
import pandas as pd
import pytest
from conftest import SF

from assaysift.functions import ordering
from assaysift.operators import features, metrics
from assaysift.plans import catalog


def _expected(frame):
    out = {}
    for key, own in frame.groupby("g", dropna=False):
        own = own[np.isfinite(own["x"]) & np.isfinite(own["y"])]
        flat = len(own) < 2 or own["x"].nunique() < 2 or own["y"].nunique() < 2
        r = own[["x", "y"]].rank()
        out[None if pd.isna(key) else key] = (len(own), *((None, None) if flat else (r["x"].corr(r["y"]), own["x"].corr(own["y"]))))
    return out


@pytest.mark.parametrize("grouped", [True, False])
@pytest.mark.parametrize("copy_rows", [4_000_000, 3])
def test_correlations_order_distinct_values_alone(spark, grouped, copy_rows, monkeypatch):
    """Ties, missing and infinite values, a missing group, constants and heavy values; only distinct values are ordered."""
    place, placed = ordering._place, []

    def record(df, group, order):
        placed.append(df.count())
        return place(df, group, order)

    monkeypatch.setattr(ordering, "_place", record)
    monkeypatch.setattr(ordering, "COPY_ROWS", copy_rows)
    rng = np.random.default_rng(2)
    n = 900
    frame = pd.DataFrame({"x": rng.integers(0, 12, n) + 1e6, "y": rng.integers(-4, 5, n) / 4.0, "g": rng.choice(["a", "b", None], n)})
    frame.loc[:20, "x"], frame.loc[30:40, "y"], frame.loc[50, "x"] = np.nan, np.nan, np.inf
    frame = pd.concat([frame, pd.DataFrame({"x": [1.0, 1.0, 0.1, 0.1, 7.0], "y": [2.0, 3.0, 0.3, 0.3, 7.0], "g": list("ccdde")})], ignore_index=True)
    if not grouped:
        frame["g"] = "all"
    rows = [(float(x), float(y), None if pd.isna(g) else g) for x, y, g in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    found = metrics.correlations(df, ["g"] if grouped else [], "x", "y").collect()
    want = _expected(frame)
    assert len(found) == len(want)
    for row in found:
        n_rows, *both = want[row["g"] if grouped else "all"]
        assert row["n"] == n_rows
        for name, value in zip(("spearman", "pearson"), both, strict=True):
            assert row[name] == (None if value is None else pytest.approx(value, abs=1e-9)), (row, name)
    assert placed and max(placed) <= 60


def test_pair_summary_ranks_predictions_once(spark, monkeypatch):
    made, ranked = features.rank_summary, []
    monkeypatch.setattr(features, "rank_summary", lambda *a, **k: ranked.append(1) or made(*a, **k))
    assert catalog.pair_summary(spark, SF).count() and len(ranked) == 1
