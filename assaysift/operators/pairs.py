"""Comparisons of the targets of one class: wide tables, pairs and triplets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.functions.labels import class_label, strain_label
from assaysift.functions.numeric import coerce_number, col
from assaysift.functions.ordering import row_positions
from assaysift.operators.keys import require_columns
from assaysift.operators.metrics import correlations
from assaysift.session import local_table
from assaysift.sources import registry

# dataset label -> ((target, strain), ...) in comparison order
Members = Mapping[str, Sequence[tuple[str, str]]]


def strain_members() -> dict[str, list[tuple[str, str]]]:
    """Return the classes that hold exactly the compared strains, with their targets in strain order."""
    out = {}
    for target_class in registry.TARGET_CLASSES:
        by_strain = {t.strain: t.name for t in registry.all_targets() if t.target_class == target_class}
        if set(by_strain) == set(registry.STRAIN_ORDER):
            out[target_class] = [(by_strain[s], s) for s in registry.STRAIN_ORDER]
    return out


def eligible_rows(df: DataFrame, members: Members) -> DataFrame:
    """Keep rows of the members' targets, in datasets where every member target was observed; add ``__at``.

    The member table has one row per configured target and is broadcast.
    """
    spark = df.sparkSession
    flat = [(d, t, i, len(ts)) for d, ts in members.items() for i, (t, _) in enumerate(ts)]
    kinds = {"dataset_label": "string", "target": "string", "__at": "int", "__size": "int"}
    table = local_table(spark, flat, kinds)
    rows = df.join(F.broadcast(table), ["dataset_label", "target"])
    # Bounded by the member table: one row per dataset.
    seen = rows.groupBy("dataset_label").agg(F.size(F.collect_set("__at")).alias("__seen"), F.max("__size").alias("__need"))
    complete = seen.where("__seen = __need").select("dataset_label")
    return rows.join(F.broadcast(complete), "dataset_label", "left_semi").drop("__size")


def wide_by_target(rows: DataFrame, size: int, values: Mapping[str, Column]) -> DataFrame:
    """Return one row per (dataset, id) with ``<value>_<i>`` for the i-th member target.

    Of rows that repeat a cell the one with the largest values counts as a whole: values of two rows are never mixed.
    """
    cell = F.struct(*[value.alias(name) for name, value in values.items()])
    picks = [F.max(F.when(col("__at") == i, cell)).alias(f"__cell_{i}") for i in range(size)]
    wide = rows.groupBy("dataset_label", "id").agg(*picks)
    return wide.select(
        "dataset_label", "id", *[F.col(f"__cell_{i}").getField(n).alias(f"{n}_{i}") for n in values for i in range(size)]
    )


def _per_dataset(members: Members, position: int, field: int) -> Column:
    """Return the target (field 0) or strain (field 1) of the i-th member of the row's dataset."""
    pairs = [F.lit(x) for d, ts in members.items() for x in (d, ts[position][field])]
    return F.try_element_at(F.create_map(*pairs), col("dataset_label"))


def _member_count(members: Members) -> int:
    sizes = {len(ts) for ts in members.values()}
    if len(sizes) != 1:
        raise ValueError("all datasets must compare the same number of targets")
    return sizes.pop()


def target_pairs(oof: DataFrame, members: Members | None = None) -> DataFrame:
    """Return, per compound and ordered pair of targets with both values known, observed and predicted differences."""
    members = strain_members() if members is None else members
    require_columns(oof, ["dataset_label", "id", "target", "label_pkd", "pred_mean", "outer_fold"], "oof table")
    size = _member_count(members)
    rows = eligible_rows(oof, members)
    wide = wide_by_target(
        rows,
        size,
        {"label": coerce_number("label_pkd"), "pred": coerce_number("pred_mean"), "fold": col("outer_fold")},
    )
    entries = []
    for a, b in combinations(range(size), 2):
        entries.append(
            F.struct(
                *[_per_dataset(members, i, 0).alias(f"target_{s}") for i, s in ((a, "a"), (b, "b"))],
                *[_per_dataset(members, i, 1).alias(f"strain_{s}") for i, s in ((a, "a"), (b, "b"))],
                *[col(f"label_{i}").alias(f"label_pkd_{s}") for i, s in ((a, "a"), (b, "b"))],
                *[col(f"pred_{i}").alias(f"pred_mean_{s}") for i, s in ((a, "a"), (b, "b"))],
                *[col(f"fold_{i}").alias(f"outer_fold_{s}") for i, s in ((a, "a"), (b, "b"))],
            )
        )
    pairs = wide.select("dataset_label", "id", F.explode(F.array(*entries)).alias("e")).select("dataset_label", "id", "e.*")
    pairs = pairs.dropna(subset=["label_pkd_a", "label_pkd_b", "pred_mean_a", "pred_mean_b"])
    observed = col("label_pkd_a") - col("label_pkd_b")
    predicted = col("pred_mean_a") - col("pred_mean_b")
    shown_a, shown_b = strain_label(col("strain_a")), strain_label(col("strain_b"))
    return pairs.select(
        "dataset_label",
        class_label(col("dataset_label")).alias("dataset_display"),
        "id",
        "target_a",
        "target_b",
        "strain_a",
        "strain_b",
        shown_a.alias("strain_a_display"),
        shown_b.alias("strain_b_display"),
        F.concat(shown_a, F.lit(" - "), shown_b).alias("strain_pair"),
        "label_pkd_a",
        "label_pkd_b",
        "pred_mean_a",
        "pred_mean_b",
        observed.alias("observed_delta_pkd"),
        predicted.alias("predicted_delta_pkd"),
        F.abs(observed).alias("observed_pair_divergence"),
        F.abs(predicted).alias("predicted_pair_divergence"),
        (observed - predicted).alias("delta_residual"),
        F.abs(observed - predicted).alias("abs_delta_error"),
        "outer_fold_a",
        "outer_fold_b",
    )


def _three(members: Members) -> None:
    if _member_count(members) != 3:
        raise ValueError("triplets need exactly three targets per dataset")


def _mean3(prefix: str) -> Column:
    return (col(f"{prefix}_0") + col(f"{prefix}_1") + col(f"{prefix}_2")) / F.lit(3.0)


def _worst(prefix: str, members: Members) -> Column:
    """Return the strain of the smallest value; ties go to the earlier member."""
    lowest = F.least(*[col(f"{prefix}_{i}") for i in range(3)])
    return (
        F.when(col(f"{prefix}_0") == lowest, _per_dataset(members, 0, 1))
        .when(col(f"{prefix}_1") == lowest, _per_dataset(members, 1, 1))
        .otherwise(_per_dataset(members, 2, 1))
    )


def _by_strain(members: Members, prefix: str, out: str) -> list[Column]:
    strains = [s for _, s in next(iter(members.values()))]
    return [col(f"{prefix}_{i}").alias(f"{out}_{s}") for i, s in enumerate(strains)]


def oof_triplets(oof: DataFrame, members: Members | None = None, strategy: str = "auto") -> DataFrame:
    """Return compounds observed and predicted on all three targets, numbered per dataset from strongest to weakest."""
    members = strain_members() if members is None else members
    _three(members)
    names = {"label": "label_pkd", "pred": "pred_mean", "residual": "residual", "abs_error": "abs_error"}
    require_columns(oof, ["dataset_label", "id", "target", *names.values()], "oof table")
    wide = wide_by_target(eligible_rows(oof, members), 3, {k: coerce_number(v) for k, v in names.items()})
    complete = wide.dropna(subset=[f"{p}_{i}" for p in ("label", "pred") for i in range(3)])
    observed, predicted = _worst("label", members), _worst("pred", members)
    spans = {p: [F.least(*v), F.greatest(*v)] for p in ("label", "pred") for v in [[col(f"{p}_{i}") for i in range(3)]]}
    rows = complete.select(
        "dataset_label",
        class_label(col("dataset_label")).alias("dataset_display"),
        "id",
        _mean3("label").alias("observed_mean_pkd"),
        _mean3("pred").alias("predicted_mean_pkd"),
        observed.alias("observed_worst_strain"),
        strain_label(observed).alias("observed_worst_strain_display"),
        predicted.alias("predicted_worst_strain"),
        strain_label(predicted).alias("predicted_worst_strain_display"),
        spans["label"][0].alias("observed_worst_pkd"),
        spans["pred"][0].alias("predicted_worst_pkd"),
        (spans["label"][1] - spans["label"][0]).alias("observed_strain_range"),
        (spans["pred"][1] - spans["pred"][0]).alias("predicted_strain_range"),
        *[c for k, v in names.items() for c in _by_strain(members, k, v)],
    )
    order = [("observed_mean_pkd", False), ("observed_strain_range", False), ("id", True)]
    numbered = row_positions(rows, ["dataset_label"], order, "heatmap_row", strategy=strategy)
    strains = [s for _, s in next(iter(members.values()))]
    tail = [f"{v}_{s}" for s in strains for v in names.values()]
    head = [c for c in rows.columns if c not in tail]
    return numbered.select(*head, "heatmap_row", *tail)


def final_triplets(final: DataFrame, members: Members | None = None) -> DataFrame:
    """Return compounds predicted on all three targets with mean, middle, best and worst prediction."""
    members = strain_members() if members is None else members
    _three(members)
    require_columns(final, ["dataset_label", "id", "target", "pred_mean"], "final inference table")
    flag = registry.OVERLAP
    assayed = coerce_number(flag) if flag in final.columns else F.lit(0.0)
    wide = wide_by_target(eligible_rows(final, members), 3, {"pred": coerce_number("pred_mean"), "seen": assayed})
    complete = wide.dropna(subset=[f"pred_{i}" for i in range(3)])
    ordered = F.sort_array(F.array(*[col(f"pred_{i}") for i in range(3)]))
    worst = _worst("pred", members)
    seen = F.greatest(*[F.coalesce(col(f"seen_{i}"), F.lit(0.0)) for i in range(3)])
    return complete.select(
        "dataset_label",
        class_label(col("dataset_label")).alias("dataset_display"),
        "id",
        _mean3("pred").alias("predicted_mean_pkd"),
        F.get(ordered, 1).alias("predicted_middle_pkd"),
        F.get(ordered, 2).alias("predicted_max_pkd"),
        worst.alias("worst_strain"),
        strain_label(worst).alias("worst_strain_display"),
        F.get(ordered, 0).alias("worst_strain_pred_pkd"),
        (F.get(ordered, 2) - F.get(ordered, 0)).alias("predicted_strain_range"),
        seen.cast("int").alias("in_experimental_data_any"),
        *_by_strain(members, "pred", "pred_mean"),
    )


def unassayed_profile(triplets: DataFrame, strategy: str = "auto") -> DataFrame:
    """Rank compounds without labels by mean, middle and best prediction."""
    rows = triplets.where(F.coalesce(coerce_number("in_experimental_data_any"), F.lit(0.0)) == 0)
    order = [("predicted_mean_pkd", False), ("predicted_middle_pkd", False), ("predicted_max_pkd", False), ("id", True)]
    return row_positions(rows, [], order, "unassayed_prediction_rank", strategy=strategy)


def pair_summary(
    oof: DataFrame,
    pairs: DataFrame,
    triplets: DataFrame,
    final: DataFrame,
    members: Members | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Summarise pairs per dataset and per strain pair, with compound and triplet counts."""
    members = strain_members() if members is None else members
    levels = pairs.withColumn("strain_pair", F.explode(F.array(F.lit("all"), col("strain_pair"))))
    keys = ["dataset_label", "strain_pair"]
    scores = correlations(levels, keys, "observed_delta_pkd", "predicted_delta_pkd", strategy).drop("n", "pearson")
    sizes = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("abs_delta_error").alias("mae"))
    flat = [(d, t) for d, ts in members.items() for t, _ in ts]
    table = local_table(oof.sparkSession, flat, {"dataset_label": "string", "target": "string"})
    # Count distinct compounds in two steps, so that no task sees more than its share of ids.
    ids = oof.join(F.broadcast(table), ["dataset_label", "target"]).select("dataset_label", "id").distinct()
    compounds = ids.groupBy("dataset_label").agg(F.count(F.lit(1)).alias("oof_compounds"))
    complete = triplets.groupBy("dataset_label").agg(F.count(F.lit(1)).alias("complete_oof_triplets"))
    predicted = final.groupBy("dataset_label").agg(F.count(F.lit(1)).alias("final_triplets"))
    labels = pairs.select("dataset_label").union(triplets.select("dataset_label")).union(final.select("dataset_label"))
    frame = labels.distinct().withColumn("strain_pair", F.lit("all"))
    known = frame.unionByName(sizes.where("strain_pair <> 'all'").select(*keys))
    joined = known.join(sizes, keys, "left").join(scores, keys, "left")
    for counts in (compounds, complete, predicted):
        joined = joined.join(counts, "dataset_label", "left")
    zero = F.lit(0).cast("long")
    n_oof, n_complete = F.coalesce("oof_compounds", zero), F.coalesce("complete_oof_triplets", zero)
    return joined.select(
        F.when(col("strain_pair") == "all", "dataset").otherwise("pair").alias("summary_level"),
        "dataset_label",
        class_label(col("dataset_label")).alias("dataset_display"),
        "strain_pair",
        F.coalesce("n", zero).alias("n"),
        "spearman",
        "mae",
        n_oof.alias("oof_compounds"),
        n_complete.alias("complete_oof_triplets"),
        F.greatest(n_oof - n_complete, zero).alias("incomplete_oof_compounds"),
        F.coalesce("final_triplets", zero).alias("final_triplets"),
    ).orderBy("dataset_display", "summary_level", "strain_pair")
