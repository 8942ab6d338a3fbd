import glob
import os

import pandas as pd
import pytest
import yaml
from conftest import pdf

from assaysift.functions import console, labels
from assaysift.operators import selection
from assaysift.plans import __main__ as cli
from assaysift.sources import config, results


def write_run(tmp_path, **changes):
    run = {"jobs": [{"dataset_mode": "single_target", "targets": ["furin", "fasn"], "comparison_preset": "single_target_standard"}], **changes}
    path = tmp_path / "run.yml"
    path.write_text(yaml.safe_dump(run))
    return str(path)


def test_jobs_expand(tmp_path, capsys):
    path = write_run(tmp_path, settings={"tuning_n_trials": 5, "outer_split_params": {"n_splits": 4}})
    jobs = config.load_run_config(path)["jobs"]
    assert [j["output_label"] for j in jobs] == ["furin", "fasn"]
    assert jobs[0]["outer_split_params"] == {"n_splits": 4, "shuffle": True, "random_state": 42}
    assert len(jobs[0]["comparisons"]) == 8 and jobs[0]["comparisons"][4]["name"] == "method_scores_plus_method_ranks_plus_rank_summary"
    assert len(config.preset("family_hierarchical")) == 7
    cli.main(["learn", "--config", path, "--dry-run"])
    assert "comparison method_scores: method_scores" in capsys.readouterr().out
    assert console.show({"b": 1, "a": None}) == "a=None, b=1" and console.wrap_label("a b", 1) == "a\nb"


@pytest.mark.parametrize(
    "job",
    [
        {"dataset_mode": "other", "target": "furin", "comparison_preset": "single_target_standard"},
        {"dataset_mode": "single_target", "comparison_preset": "single_target_standard"},
        {"dataset_mode": "single_target", "target": "furin", "targets": ["fasn"], "comparison_preset": "single_target_standard"},
        {"dataset_mode": "single_target", "target": "mars", "comparison_preset": "single_target_standard"},
        {"dataset_mode": "single_target", "target": "furin"},
        {"dataset_mode": "single_target", "target": "furin", "comparisons": []},
        {"dataset_mode": "single_target", "target": "furin", "comparisons": [{"name": "a", "feature_requests": [{"feature_set": "x"}]}]},
        {"dataset_mode": "single_target", "targets": ["furin", "fasn"], "output_label": "x", "comparison_preset": "single_target_standard"},
        {"dataset_mode": "single_target", "target": "furin", "output_label": "a/b", "comparison_preset": "single_target_standard"},
        {"dataset_mode": "single_target", "target": "furin", "surprise": 1, "comparison_preset": "single_target_standard"},
        {"dataset_mode": "single_target", "target": "furin", "settings": {"model_runs": []}, "comparison_preset": "single_target_standard"},
    ],
)
def test_bad_jobs_are_refused(tmp_path, job):
    with pytest.raises(ValueError):
        config.load_run_config(write_run(tmp_path, jobs=[job]))


def test_duplicate_labels_are_refused(tmp_path):
    job = {"dataset_mode": "single_target", "target": "furin", "comparison_preset": "single_target_standard"}
    with pytest.raises(ValueError, match="Duplicate output labels"):
        config.load_run_config(write_run(tmp_path, jobs=[job, job]))
    with pytest.raises(FileNotFoundError):
        config.load_run_config(str(tmp_path / "absent.yml"))


def test_result_discovery(spark, tmp_path):
    assert results.dataset_of("na_random_kfold_cv_nested_tuning") == "na" and results.dataset_of("odd") == "odd"
    with pytest.raises(FileNotFoundError):
        results.evaluation_runs(spark, str(tmp_path), "r")
    folder = tmp_path / "r" / "evaluation"
    folder.mkdir(parents=True)
    (folder / "na_group_kfold_cv_summary.csv").write_text("summary\nx\n")
    with pytest.raises(FileNotFoundError, match="missing"):
        results.evaluation_runs(spark, str(tmp_path), "r")
    with pytest.raises(FileNotFoundError):
        results.selected_runs(spark, str(tmp_path), "r")


def test_labels(spark):
    df = spark.createDataFrame([("na",), ("na_h5n1",), ("pa_x9",), ("zz_1",), ("furin",)], "t string")
    got = [r[0] for r in df.select(labels.target_label(labels.F.col("t"))).collect()]
    assert got == ["NA", "NA H5N1", "PA X9", "zz_1", "Furin"]
    assert labels.metric_label("ef_2p5pct") == "EF 2.5%" and labels.metric_label("precision_at_10") == "Precision@10"
    assert labels.disagreement_label("branch_rank_sd") == "Branch percentile-rank SD"
    one = spark.createDataFrame([("x" * 50,)], "t string").select(labels.shorten(labels.F.col("t"))).first()[0]
    assert len(one) == 42 and one.endswith("...")


GOLDEN = os.environ.get("GOLDEN_RESULTS_DIR", "")


@pytest.mark.skipif(not glob.glob(f"{GOLDEN}/evaluation/*_fold_metrics.csv"), reason="no published results to replay")
def test_published_results_replay(spark):
    """Recompute summaries, selections, winners and family tables from published fold metrics."""
    folds = []
    for path in sorted(glob.glob(f"{GOLDEN}/evaluation/*_fold_metrics.csv")):
        label = results.dataset_of(os.path.basename(path).removesuffix("_fold_metrics.csv"))
        table = results.read_result(spark, path)
        folds.append(table.select(labels.F.lit(label).alias("dataset_label"), "*"))
        keys = ["comparison_name", "model_type"]
        got = pdf(selection.cv_summary(table), *keys)
        published = pd.read_csv(path.replace("_fold_metrics", "_summary")).sort_values(keys).reset_index(drop=True)
        for c in got.columns:
            if c in published and published[c].dtype.kind == "f":
                pd.testing.assert_series_equal(got[c].astype(float), published[c], check_names=False, atol=1e-12, rtol=0)
        chosen = pdf(selection.select_candidates(folds[-1], "spearman"), *keys)
        summary = pd.read_csv(f"{GOLDEN}/selected_models/{label}_selected_model_summary.csv", keep_default_na=False)
        summary = summary.sort_values(keys).reset_index(drop=True)
        for c in ("one_se_eligible", "official_selected"):
            assert list(chosen[c]) == list(summary[c].astype(str) == "True")
        for c in ("spearman_mean", "spearman_std", "spearman_sem", "one_se_threshold"):
            assert abs(chosen[c] - summary[c].astype(float)).max() < 5.1e-5
    every = folds[0]
    for table in folds[1:]:
        every = every.unionByName(table)
    shown = f"{GOLDEN}/visualizations/evaluation"
    winners = pdf(selection.fold_winners(every), "dataset_label", "outer_fold")
    published = pd.read_csv(f"{shown}/fold_winner_stability.csv", keep_default_na=False).sort_values(["dataset_label", "outer_fold"])
    assert list(winners["winner_label"]) == list(published["winner_label"])
    keys = ["dataset_label", "model_type", "p", "comparison_name"]
    family = pdf(selection.family_summary(every), *keys)
    published = pd.read_csv(f"{shown}/model_family_feature_summary.csv", keep_default_na=False).sort_values(keys)
    assert list(family["row_label"]) == list(published["row_label"])
    for c in ("spearman_mean", "spearman_std"):
        assert abs(family[c].to_numpy() - published[c].astype(float).to_numpy()).max() < 1e-12
