import pytest
import yaml
from fixture_data import write

from assaysift.plans import diagnostics, learner
from assaysift.sources import config, results
from assaysift.streaming import trial_trace


def one_csv(spark, path):
    return spark.read.option("header", True).option("escape", '"').csv(path).toPandas()


@pytest.fixture(scope="module")
def job(tmp_path_factory):
    root = tmp_path_factory.mktemp("screen")
    write(f"{root}/data")
    run = {
        "settings": {
            "data_dir": f"{root}/data",
            "results_dir": f"{root}/results",
            "train_round_id": "round_one",
            "outer_split_params": {"n_splits": 2, "shuffle": True, "random_state": 42},
            "inner_split_params": {"n_splits": 2, "shuffle": True, "random_state": 43},
            "tuning_n_trials": 11,
            "ensemble_size_m": 5,
            "model_runs": [{"model_type": "ridge", "model_params": {"alpha": 1.0}, "standardize_features": True}],
        },
        "jobs": [
            {
                "dataset_mode": "target_class",
                "target_class": "na",
                "comparisons": [
                    {"name": "method_scores", "feature_requests": [{"feature_set": "method_scores"}]},
                    {
                        "name": "method_ranks_plus_rank_summary",
                        "feature_requests": [{"feature_set": "method_ranks"}, {"feature_set": "method_rank_summary"}],
                    },
                ],
            }
        ],
    }
    path = root / "run.yml"
    path.write_text(yaml.safe_dump(run))
    return config.load_run_config(str(path))["jobs"][0]


@pytest.fixture(scope="module")
def done(spark, job):
    return learner.run_job(spark, job)


def test_fold_metrics_and_summary(spark, done):
    folds = one_csv(spark, done["fold_path"])
    assert len(folds) == 2 * 2
    numeric = folds.assign(spearman=folds["spearman"].astype(float), n_test=folds["n_test"].astype(int), n_train=folds["n_train"].astype(int))
    assert (numeric["spearman"] > 0.5).all()
    assert len(set(numeric["n_test"] + numeric["n_train"])) == 1
    summary = one_csv(spark, done["summary_path"]).sort_values("comparison_name")
    means = numeric.groupby("comparison_name")["spearman"].mean().round(4)
    assert [float(v) for v in summary["spearman"]] == pytest.approx(list(means), abs=1e-4)
    assert summary["selected_model_params_by_outer_fold"].str.startswith("fold_0={'alpha': ").all()
    assert set(summary["p"].astype(int)) == {6, 15}


def test_trace_and_inference(spark, done):
    trace = one_csv(spark, done["trace_path"])
    assert len(trace) == 2 * (2 + 1) * 11
    best = trace.assign(s=trace["tuning_score"].astype(float), b=trace["best_tuning_score_so_far"].astype(float))
    for _, study in best.groupby(["selection_scope", "comparison_name"]):
        ordered = study.assign(n=study["trial_number"].astype(int)).sort_values("n")
        assert list(ordered["s"].cummax()) == list(ordered["b"])
    merged = one_csv(spark, done["merged_inference_path"])
    assert {"pred_mean_method_scores_ridge", "pred_err_method_scores_ridge", "in_experimental_data"} <= set(merged.columns)
    assert not merged.duplicated(["id", "target"]).any()
    assert (merged["pred_err_method_scores_ridge"].astype(float) > 0).all()


def test_selected_outputs(spark, done, job):
    chosen = done["selected"]
    oof_rows = one_csv(spark, chosen["paths"]["oof"])
    assert len(oof_rows) == done["candidates"][0].training.count()
    coverage = oof_rows["covered"].astype(float).mean()
    assert 0.75 <= coverage <= 1.0
    assert set(oof_rows["pred_score_decile"].astype(int)) == set(range(1, 11))
    assert set(oof_rows["scaffold_coverage_group"]) == {"unknown"}  # no RDKit here
    runs = results.selected_runs(spark, job["results_dir"], "round_one")
    manifest = results.selected_manifests(spark, runs)["na"]
    assert manifest["model_type"] == "ridge" and manifest["selection"]["n_outer_folds"] == 2
    summary = results.selected_summaries(spark, runs).toPandas()
    assert (summary["official_selected"] == "true").sum() == 1


def test_diagnostics_follow(spark, done, job):
    tables = diagnostics.evaluation_diagnostics(spark, job["results_dir"], "round_one")
    winners = one_csv(spark, tables["fold_winner_stability"])
    assert len(winners) == 2
    landscape = one_csv(spark, tables["ridge_inner_cv_tuning_score_landscape"])
    assert landscape["trial_count"].astype(int).sum() == 2 * 2 * 11
    selected = diagnostics.selected_model_diagnostics(spark, job["results_dir"], "round_one")
    summary = one_csv(spark, selected["prediction_summary"])
    assert list(summary["target"]) == ["all", "na_h3n2", "na_h5n1", "na_ph1n1"]
    cross = one_csv(spark, selected["cross_strain_summary"])
    assert list(cross["strain_pair"])[0] == "all" and len(cross) == 4


def test_trace_can_be_followed_as_a_stream(spark, done, tmp_path):
    query = (
        trial_trace.best_so_far(trial_trace.trace_stream(spark, done["trace_path"]))
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("followed_trace")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.sql("SELECT * FROM followed_trace").toPandas()
    assert len(rows) == 2 * 3 and (rows["trials"] == 11).all()


def test_point_mode_without_tuning(spark, job, tmp_path):
    plain = {
        **job,
        "results_dir": str(tmp_path / "results"),
        "tuning_mode": None,
        "inference_mode": "point",
        "output_label": "na_point",
        "model_runs": [{"model_type": "xgboost", "model_params": {"n_estimators": 3, "max_depth": 2}}],
        "comparisons": job["comparisons"][:1],
    }
    done = learner.run_job(spark, plain)
    folds = one_csv(spark, done["fold_path"])
    assert set(folds["tuning_mode"]) == {"no_tuning"} and len(folds) == 2
    inference = one_csv(spark, done["selected"]["paths"]["final"])
    assert "prediction" in inference.columns
