import numpy as np
import pandas as pd
import pytest
from conftest import pdf

from assaysift.operators import extrapolation, similarity


def similarity_of(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(8)
    # bit 0 is in a third of all sets
    return {f"q{i:02d}": sorted(set(rng.choice(30, rng.integers(0, 9), replace=False).tolist()) | ({0} if i % 3 == 0 else set())) for i in range(40)}


@pytest.mark.parametrize("blocks", [False, True])
def test_nearest_labelled(spark, sets, blocks, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_SETS", 7)
    monkeypatch.setattr(similarity, "CHUNK_ROWS", 11)
    names = list(sets)
    targets = ["t1", "t2"]
    q = pd.DataFrame({"target_class": ["x" if i < 35 else "empty" for i in range(40)], "id": names, "target": [targets[i % 2] for i in range(40)], "bits": list(sets.values())})
    labelled = [("x", n, targets[i % 3 == 0], sets[n]) for i, n in enumerate(names[:25])] + [("x", "zz", "t1", [99])]
    schema = "target_class string, id string, target string, bits array<bigint>"
    got = pdf(
        similarity.nearest_labelled(
            spark.createDataFrame(q.values.tolist(), schema), spark.createDataFrame(labelled, schema), "bits", force_blocks=blocks
        ),
        "id",
    )
    for _, row in got.iterrows():
        query = q[q["id"] == row["id"]].iloc[0]
        group = sorted((n, t, b) for c, n, t, b in labelled if c == query["target_class"])
        if not group:
            assert row["nearest_labeled_id"] is None and np.isnan(row["nearest_labeled_tanimoto"])
            continue
        best = min(group, key=lambda g: (-similarity_of(query["bits"], g[2]), g[0], g[1]))
        assert row["nearest_labeled_id"] == best[0]
        assert row["nearest_labeled_tanimoto"] == pytest.approx(similarity_of(query["bits"], best[2]))
        same = [g for g in group if g[1] == query["target"]]
        best = min(same, key=lambda g: (-similarity_of(query["bits"], g[2]), g[0]))
        assert row["nearest_labeled_same_target_id"] == best[0]


def test_long_sets_are_cut_by_elements(spark, monkeypatch):
    """A task's rows are bounded by their elements, not by their number alone."""
    sizes, nearest = spark.sparkContext.accumulator(0), similarity._nearest
    monkeypatch.setattr(similarity, "BLOCK_ELEMENTS", 300)
    monkeypatch.setattr(similarity, "_nearest", lambda rows, refs, index: sizes.add(1) or nearest(rows, refs, index))
    rows = spark.range(40).selectExpr("'x' target_class", "id", "'t' target", "sequence(id, id + 49) bits")
    found = similarity.nearest_labelled(rows, rows.where("id % 20 = 0"), "bits", force_blocks=True)
    assert [r["nearest_labeled_id"] for r in found.orderBy("id").collect()] == [0] * 11 + [20] * 29
    assert sizes.value >= 4


def test_missing_groups_and_targets_match_themselves(spark):
    schema = "target_class string, id string, target string, bits array<bigint>"
    q = [(None, "a", "t", [1, 2]), ("x", "b", None, [3]), ("y", "c", "t", [1])]
    labelled = [(None, "m", "t", [1]), (None, "m", "t", [1, 2, 3]), ("x", "n", None, [3]), ("x", "o", "t", [3])]
    plans = [
        pdf(similarity.nearest_labelled(spark.createDataFrame(q, schema), spark.createDataFrame(labelled, schema), "bits", force_blocks=f), "id")
        for f in (False, True)
    ]
    pd.testing.assert_frame_equal(*plans)
    assert list(plans[0]["nearest_labeled_id"].fillna("-")) == ["m", "n", "-"]
    assert plans[0]["nearest_labeled_tanimoto"][0] == 0.5 and plans[0]["nearest_labeled_same_target_id"][1] == "n"


def test_nothing_labelled(spark, sets):
    schema = "target_class string, id string, target string, bits array<bigint>"
    q = spark.createDataFrame([("x", "a", "t", [1])], schema)
    got = similarity.nearest_labelled(q, spark.createDataFrame([], schema), "bits").first()
    assert got["nearest_labeled_id"] is None and got["nearest_labeled_tanimoto"] is None


def brute_k_medoids(d, k):
    medoids = [int(np.argmin(np.round(d.sum(1), 9)))]
    while len(medoids) < k:
        nearest = d[:, medoids].min(1)
        nearest[medoids] = -np.inf
        medoids.append(int(np.argmax(nearest)))
    assign = d[:, medoids].argmin(1)
    cost = d[np.arange(len(d)), np.array(medoids)[assign]].sum()
    while True:
        new = []
        for c, m in enumerate(medoids):
            members = np.flatnonzero(assign == c)
            new.append(m if not len(members) else int(members[np.argmin(np.round(d[np.ix_(members, members)].sum(1), 9))]))
        new_assign = d[:, new].argmin(1)
        new_cost = d[np.arange(len(d)), np.array(new)[new_assign]].sum()
        if new == medoids or new_cost >= cost:
            return assign
        medoids, assign, cost = new, new_assign, new_cost


@pytest.mark.parametrize("blocks", [False, True])
def test_k_medoids_matches_dense_matrix(spark, sets, blocks, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_SETS", 9)
    monkeypatch.setattr(similarity, "CHUNK_ROWS", 13)
    names = list(sets)
    d = np.array([[1 - similarity_of(sets[a], sets[b]) for b in names] for a in names])
    df = spark.createDataFrame([(n, sets[n]) for n in names], "id string, bits array<bigint>")
    sums = pdf(similarity.distance_sums(df, "id", "bits", block_sets=9 if blocks else None), "id")
    np.testing.assert_allclose(sums["total"], d.sum(1), rtol=1e-12)
    got = pdf(similarity.k_medoids(df, "id", "bits", 4, block_sets=9 if blocks else None), "id")
    expected = brute_k_medoids(d, 4)
    np.testing.assert_array_equal(got["chem_cluster_id"], expected)
    np.testing.assert_array_equal(got["chem_cluster_size"], np.bincount(expected)[expected])
    with pytest.raises(ValueError):
        similarity.k_medoids(df, "id", "bits", 41)


@pytest.mark.parametrize("copies", [4, 1])
def test_k_medoids_of_copies(spark, copies, monkeypatch):
    """Copies are compared once; only where clusters outnumber the sets they are points of their own."""
    units, seen = similarity._sum_units, []
    monkeypatch.setattr(similarity, "_sum_units", lambda rows, *a: seen.append(rows.count()) or units(rows, *a))
    rng = np.random.default_rng(12)
    own = [sorted(rng.choice(25, 7, replace=False).tolist()) for _ in range(15)] if copies == 4 else [[1, 2], [2, 3]]
    sets = [list(reversed(own[i % len(own)])) if i % 2 else own[i % len(own)] for i in range(4 * len(own))]
    d = np.array([[1 - similarity_of(a, b) for b in sets] for a in sets])
    k = 4 if copies == 4 else 3
    got = pdf(similarity.k_medoids(spark.createDataFrame(list(enumerate(sets)), "id long, bits array<bigint>"), "id", "bits", k), "id")
    expected = brute_k_medoids(d, k)
    np.testing.assert_array_equal(got["chem_cluster_id"], expected)
    np.testing.assert_array_equal(got["chem_cluster_size"], np.bincount(expected)[expected])
    assert set(seen) == {15 if copies == 4 else 8}


@pytest.mark.parametrize("some", [True, False])
def test_distance_sums_of_missing_clusters(spark, sets, some, monkeypatch):
    """A missing cluster is one value in both plans, also where no cluster is known."""
    monkeypatch.setattr(similarity, "BLOCK_SETS", 4)
    monkeypatch.setattr(similarity, "CHUNK_ROWS", 5)
    rows = [(n, i % 3 if some and i % 3 else None, sets[n]) for i, n in enumerate(sets)]
    df = spark.createDataFrame(rows, "id string, label int, bits array<bigint>")
    want = {n: (c, sum(1 - similarity_of(b, x) for _, d, x in rows if c == d)) for n, c, b in rows}
    for blocks in (False, True):
        got = similarity.distance_sums(df, "id", "bits", "label", block_sets=4 if blocks else None).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["cluster"], r["total"]) == (want[r["id"]][0], pytest.approx(want[r["id"]][1]))


def test_small_blocks_of_many_sets_grow(spark):
    """Blocks of two sets would need 245,350 pairs of blocks for 1,400 sets; a few hundred do."""
    rng = np.random.default_rng(3)
    sets = [sorted(rng.choice(40, 9, replace=False).tolist()) for _ in range(1_400)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, bits array<bigint>")
    stored = df.selectExpr("0L code", "id sid", "bits set", "1L n")
    assert [r["blocks"] for r in similarity._block_counts(stored, 2).collect()] == [similarity.MOST_BLOCKS]
    got = pdf(similarity.distance_sums(df, "id", "bits", block_sets=2), "id")
    held = np.zeros((len(sets), 40))
    for i, s in enumerate(sets):
        held[i, s] = 1
    common = held @ held.T
    np.testing.assert_allclose(got["total"], (1 - common / (18 - common)).sum(1), rtol=1e-12)


def test_full_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ELEMENTS", 50)
    stored = spark.range(40).selectExpr("id % 2 code", "id sid", "array(id, id + 1, id + 2, id + 3, id + 4) set", "1L n")
    assert [r["blocks"] for r in similarity._block_counts(stored).collect()] == [2, 2]


def test_equal_sets_count_as_often_as_they_occur(spark):
    rows = [(i, [3, 1] if i % 2 else [1, 3], i % 3) for i in range(30)] + [(30, [1], 0), (31, None, 0), (32, [], 0)]
    got = pdf(similarity.distance_sums(spark.createDataFrame(rows, "id long, bits array<bigint>, label int"), "id", "bits", "label"), "id")
    want = [0.5 + 2.0 if i % 3 == 0 else 0.0 for i in range(30)] + [5.0 + 2.0, 11.0, 11.0]
    np.testing.assert_allclose(got["total"], want, rtol=1e-12)


def test_flags_and_reasons(spark):
    rows = [("x", "a", 1, 0.2), ("x", "b", 0, 0.4), ("x", "c", 1, 0.9), ("y", "d", 1, None)]
    df = spark.createDataFrame(rows, "target_class string, id string, unseen_scaffold_flag int, nearest_labeled_tanimoto double")
    labelled = spark.createDataFrame([("x",)], "target_class string")
    got = pdf(extrapolation.flag_extrapolation(df, labelled), "id")
    assert list(got["extrapolation_reason"]) == ["unseen_scaffold|low_similarity", "", "unseen_scaffold", "no_labeled_compounds"]
    assert list(got["extrapolation_flag"]) == [1, 0, 1, 1]
    summary = extrapolation.extrapolation_summary(spark.createDataFrame(got), "set").orderBy("target_class").collect()
    assert [(r["n_rows"], r["n_extrapolation"], r["n_no_labeled_compounds"]) for r in summary] == [(3, 2, 0), (1, 1, 1)]
