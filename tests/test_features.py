import numpy as np
import pandas as pd
import pytest
from conftest import pdf
from fixture_data import METHODS, write
from pyspark.sql import functions as F

from assaysift.operators import assemble, chem, features, keys
from assaysift.sources import registry, tables


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("features"))
    return root, write(root, n=60)


@pytest.fixture(scope="module")
def store(spark, data):
    return features.FeatureStore(tables.load_predictions(spark, data[0]), "na", registry.class_targets("na"))


def expected_ranks(frames):
    merged = None
    for method in METHODS:
        f = frames[method].copy()
        f[f"{method}_score"] = f["prediction"]
        f[f"{method}_rank"] = f.groupby("target")["prediction"].rank(method="average", pct=True)
        f = f[["id", "target", f"{method}_score", f"{method}_rank"]]
        merged = f if merged is None else merged.merge(f, on=["id", "target"])
    return merged.sort_values(["id", "target"]).reset_index(drop=True)


@pytest.mark.parametrize("strategy", ["window", "split"])
def test_ranks_use_the_population_before_the_join(spark, data, strategy):
    got = pdf(features.method_table(tables.load_predictions(spark, data[0]), strategy=strategy), "id", "target")
    expected = expected_ranks(data[1])
    pd.testing.assert_frame_equal(got[expected.columns], expected, check_dtype=False)


def test_rank_summary_matches_pandas(store, data):
    got = pdf(store.features([{"feature_set": "method_rank_summary"}]), "id", "target")
    ranks = expected_ranks(data[1])
    r = ranks[[f"{m}_rank" for m in METHODS]]
    branch = {b: ranks[[f"{m}_rank" for m in ms]].mean(axis=1) for b, ms in registry.BRANCHES.items()}
    np.testing.assert_allclose(got["method_rank_sd"], r.std(axis=1, ddof=1), rtol=1e-12)
    np.testing.assert_allclose(got["method_rank_range"], r.max(axis=1) - r.min(axis=1), rtol=1e-12)
    np.testing.assert_allclose(got["branch_rank_sd"], pd.DataFrame(branch).std(axis=1, ddof=1), rtol=1e-9, atol=1e-12)
    weights = np.array([2, 2, 3, 3, 1, 1])
    np.testing.assert_allclose(got["consensus_123_rank"], (r * weights).sum(axis=1) / 12, rtol=1e-12)


def test_summary_skips_missing_ranks_but_consensus_does_not(spark):
    row = {f"{m}_rank": v for m, v in zip(METHODS, [0.1, 0.5, None, 0.4, 0.9, 0.3], strict=True)}
    df = spark.createDataFrame([("c", "t", *row.values())], "id string, target string, " + ", ".join(f"`{c}` double" for c in row))
    got = features.rank_summary(df).first()
    assert got["consensus_123_rank"] is None
    assert got["structure_rank_mean"] == pytest.approx(0.4)
    assert got["method_rank_sd"] == pytest.approx(np.std([0.1, 0.5, 0.4, 0.9, 0.3], ddof=1))


def test_missing_values_keep_their_row(spark):
    rows = [(m, "c1", "t", 1.0 if m != "balm" else None, None) for m in METHODS]
    rows += [(m, "c2", "t", 2.0, None) for m in METHODS if m != "balm"]
    df = spark.createDataFrame(rows, "method string, id string, target string, prediction double, spread double")
    got = pdf(features.method_table(df))
    assert list(got["id"]) == ["c1"] and pd.isna(got["balm_rank"][0])


def test_context_columns(store):
    got = pdf(store.features([{"feature_set": "target_context", "base_feature_set": "method_scores"}]), "id", "target")
    assert len(got.columns) == 2 + 2 + 12
    assert set(got.loc[got["target"] == "na_ph1n1", "is_h3n2"]) == {0}
    h3 = got["target"] == "na_h3n2"
    assert (got.loc[~h3, "boltz-2_score_x_h3n2"] == 0).all() and (got.loc[h3, "is_h3n2"] == 1).all()


def test_feature_requests_are_checked(store):
    for bad in (
        [],
        [{"feature_set": "nope"}],
        [{"feature_set": "target_context"}],
        [{"feature_set": "target_context", "base_feature_set": "target_context"}],
        [{"feature_set": "method_scores", "columns": ["absent"]}],
        [{"feature_set": "method_scores", "source": "round"}],
        [{"feature_set": "chemical_descriptors"}],
    ):
        with pytest.raises(ValueError):
            store.features(bad)


def test_training_and_inference_tables(spark, data, store):
    root, _ = data
    scores = store.features([{"feature_set": "method_scores"}])
    labels = tables.load_assay(spark, root, "round_one", "na_h3n2")
    training = assemble.training_table(labels, scores)
    assert training.columns[:6] == ["id", "target", "target_class", "strain", "smiles", "label_pkd"]
    assert len(assemble.feature_columns(training)) == 6
    library = tables.load_target_library(spark, root, "na_h3n2")
    inference = assemble.inference_table(library, scores)
    assert "label_pkd" not in inference.columns and inference.count() >= training.count()


def test_loaders_report_problems(spark, data, tmp_path):
    root, frames = data
    with pytest.raises(ValueError):
        tables.load_predictions(spark, root, ["unknown"])
    with pytest.raises(FileNotFoundError):
        tables.load_library(spark, root, "pa")
    broken = tmp_path / "shared" / "features"
    broken.mkdir(parents=True)
    doubled = pd.concat([frames["balm"], frames["balm"].head(1)])
    doubled.to_csv(broken / "balm_predictions.csv", index=False)
    with pytest.raises(ValueError, match="duplicate"):
        tables.load_predictions(spark, str(tmp_path), ["balm"])
    frames["balm"].drop(columns="prediction").to_csv(broken / "mammal_predictions.csv", index=False)
    with pytest.raises(ValueError, match="missing"):
        tables.load_predictions(spark, str(tmp_path), ["mammal"])


def test_class_assays_fill_round_and_keep_class(spark, data):
    rows = pdf(tables.load_class_assays(spark, data[0], tables.resolve_rounds(spark, data[0], None), "na"))
    assert set(rows["round_id"]) == {"round_one"} and set(rows["target_class"]) == {"na"}
    assert tables.load_class_assays(spark, data[0], ["round_one"], "pa").count() == 0


def test_parquet_twin_is_preferred(spark, data, tmp_path):
    path = f"{tmp_path}/t.csv"
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert tables.read_table(spark, path).count() == 3


def test_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2,), (2,), (3,)], "k int")
    assert [r[0] for r in keys.row_universe([a, b], ["k"]).orderBy("k").collect()] == [2, 3]
    flagged = keys.flag_overlap(a, b, ["k"], "hit").orderBy("k")
    assert flagged.columns == ["k", "hit", "v"] and [r["hit"] for r in flagged.collect()] == [0, 1, 1]
    with pytest.raises(ValueError, match="duplicate"):
        keys.require_unique(b, ["k"], "b")
    with pytest.raises(ValueError, match="Unknown target"):
        keys.add_registry(spark.createDataFrame([("mars",)], "target string"), registry.registry_table(spark))
    wide = keys.merge_predictions(
        {
            "a": a.select("k", F.lit(1).alias("seen"), F.lit(0.5).alias("prediction")),
            "b": a.where("k > 1").select("k", F.lit(0).alias("seen"), F.lit(2.0).alias("pred_mean"), F.lit(0.1).alias("pred_err")),
        },
        ["k"],
        "seen",
    ).orderBy("k")
    assert wide.columns == ["k", "seen", "pred_a", "pred_mean_b", "pred_err_b"]
    assert [tuple(r)[1:4] for r in wide.collect()] == [(1, 0.5, None), (1, 0.5, 2.0), (1, 0.5, 2.0)]


@pytest.mark.skipif(chem.available(), reason="RDKit present")
def test_chemistry_needs_rdkit(spark):
    df = spark.createDataFrame([("a", "CCO")], "id string, smiles string")
    for call in (chem.descriptors, chem.fingerprints, chem.scaffolds):
        with pytest.raises(ImportError):
            call(df)
    clash = spark.createDataFrame([("a", "CCO"), ("a", "CC")], "id string, smiles string")
    with pytest.raises(ValueError, match="exactly one SMILES"):
        chem.unique_compounds(clash)
