import pytest
from conftest import pdf
from fixture_data import write

from assaysift.operators import features
from assaysift.plans import datasets
from assaysift.sources import tables


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("datasets"))
    write(path, classes=("na", "pa"), n=80)
    return path


def test_pooled_tables_are_saved(spark, root):
    requests = [{"feature_set": "method_scores"}, {"feature_set": "glide_uncertainty"}]
    training, inference, saved, shared = datasets.build_dataset(
        spark, root, "round_one", ["na_ph1n1", "na_h3n2", "na_h5n1"], requests, "train.csv", "infer.csv"
    )
    assert training.columns[:6] == ["id", "target", "target_class", "strain", "smiles", "label_pkd"] and len(training.columns) == 13
    assert saved.endswith("round_one/datasets/train.csv") and shared.endswith("shared/datasets/infer.csv")
    assert spark.read.option("header", True).csv(saved).count() == training.count()
    assert inference.count() >= training.count()
    with pytest.raises(ValueError, match="one target class"):
        datasets.build_dataset(spark, root, "round_one", ["na_ph1n1", "pa_ph1n1"], requests)


def test_labels_are_standardised_and_generated(spark, root):
    library = tables.load_library(spark, root, "pa")
    raw = tables.load_assay(spark, root, "round_one", "pa_h3n2").withColumnRenamed("id", "compound_id")
    template = datasets.standardize_assay(spark, raw, library, "pa_h3n2")
    assert set(pdf(template)["strain"]) == {"h3n2"}
    with pytest.raises(ValueError, match="missing from the compound map"):
        datasets.standardize_assay(spark, raw, library.limit(3), "pa_h3n2")
    mine = tables.load_predictions(spark, root).where("target = 'na_h3n2'")
    summary = features.rank_summary(features.method_table(mine, scores=False))
    library = tables.load_library(spark, root, "na")
    with pytest.raises(ValueError, match="templates"):
        datasets.generate_assay(summary, library, template, "na_h3n2", 40, 7)
    n = template.count()
    made = pdf(datasets.generate_assay(summary, library, template, "na_h3n2", n, 7), "id")
    assert len(made) == n and made["id"].is_unique and set(made["target"]) == {"na_h3n2"}
    # the labels of the template, handed out in noisy consensus order
    assert sorted(made["label_pkd"]) == sorted(pdf(template)["label_pkd"])
    joined = made.merge(pdf(summary), on="id")
    assert joined["label_pkd"].rank().corr(joined["consensus_123_rank"].rank()) > 0.7
