"""Feature families built from long method predictions (method, id, target, prediction, spread)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaysift.functions.numeric import col, number, row_mean, row_range, row_sample_std
from assaysift.functions.ordering import percent_rank_average
from assaysift.operators.keys import require_columns
from assaysift.sources import registry


def method_table(
    predictions: DataFrame,
    methods: Sequence[str] = registry.METHODS,
    keys: Sequence[str] = registry.KEYS,
    target: str = "target",
    scores: bool = True,
    ranks: bool = True,
    strategy: str = "auto",
) -> DataFrame:
    """Spread long predictions into one row per key holding ``<method>_score`` and ``<method>_rank`` columns.

    Ranks are percentile ranks over the whole (method, target) population, taken before incomplete keys drop out. A key
    is complete when every method has a row for it; the row's value may be missing. All methods share one ranking pass
    and one shuffle by key, where joining per-method tables would take a shuffle each.
    """
    rows = predictions.where(col("method").isin(list(methods))).withColumn("prediction", number("prediction"))
    if ranks:
        rows = percent_rank_average(rows, ["method", target], "prediction", "__rank", strategy)
    picks: list[Column] = []
    for method in methods:
        here = col("method") == method
        picks.append(F.max(F.when(here, 1)).alias(f"__has_{method}"))
        if scores:
            picks.append(F.max(F.when(here, col("prediction"))).alias(f"{method}_score"))
        if ranks:
            picks.append(F.max(F.when(here, col("__rank"))).alias(f"{method}_rank"))
    wide = rows.groupBy(*[col(k) for k in keys]).agg(*picks)
    complete = sum((F.coalesce(col(f"__has_{m}"), F.lit(0)) for m in methods), F.lit(0)) == len(methods)
    return wide.where(complete).drop(*[f"__has_{m}" for m in methods])


def add_rank_summary(
    ranks: DataFrame,
    weights: Mapping[str, float] = registry.METHOD_WEIGHTS,
    branches: Mapping[str, Sequence[str]] = registry.BRANCHES,
) -> DataFrame:
    """Add branch means, weighted consensus and disagreement columns to a table of ``<method>_rank`` columns.

    Means, deviations and ranges skip missing ranks; the consensus is missing when any rank is. Means are columns of
    their own before deviations use them, so that expressions stay small.
    """
    require_columns(ranks, [f"{m}_rank" for m in weights], "method_ranks table")
    rank = {m: number(f"{m}_rank") for m in weights}
    weighted = reduce(lambda a, b: a + b, [rank[m] * F.lit(float(w)) for m, w in weights.items()])
    means = ranks.select(
        "*",
        *[row_mean([rank[m] for m in members]).alias(f"{b}_rank_mean") for b, members in branches.items()],
        (weighted / F.lit(float(sum(weights.values())))).alias("consensus_123_rank"),
        row_mean(list(rank.values())).alias("__mean"),
    )
    branch = [col(f"{b}_rank_mean") for b in branches]
    spread = means.select(
        "*",
        row_sample_std(list(rank.values()), col("__mean")).alias("method_rank_sd"),
        row_range(list(rank.values())).alias("method_rank_range"),
        row_mean(branch).alias("__branch_mean"),
    )
    return spread.select(
        *[col(c) for c in spread.columns if not c.startswith("__")],
        row_sample_std(branch, col("__branch_mean")).alias("branch_rank_sd"),
        (col("structure_rank_mean") - col("pose_rank_mean")).alias("structure_minus_pose_rank"),
        (col("sequence_rank_mean") - col("structure_rank_mean")).alias("sequence_minus_structure_rank"),
    )


def rank_summary(ranks: DataFrame, keys: Sequence[str] = registry.KEYS) -> DataFrame:
    """Return keys and the nine rank summary columns."""
    full = add_rank_summary(ranks)
    return full.select(*[col(k) for k in keys], *registry.SUMMARY_COLUMNS)


def spread_feature(predictions: DataFrame, method: str = registry.SPREAD_METHOD) -> DataFrame:
    """Return the spread of one method's predictions as a feature table."""
    rows = predictions.where(col("method") == method)
    return rows.select("id", "target", col("spread").alias(f"{method}_{registry.SPREAD_SOURCE_COLUMN}"))


def context_columns(
    features: Sequence[str], labels: Mapping[str, str], reference: str, target: str = "target"
) -> dict[str, Column]:
    """Return 0/1 indicators of each non-reference target and the product of each feature with each indicator."""
    if len(set(labels.values())) != len(labels):
        raise ValueError("labels must map targets to unique short labels.")
    if reference not in labels:
        raise ValueError(f"reference target {reference!r} is not among {list(labels)}")
    others = {t: label for t, label in labels.items() if t != reference}
    out = {f"is_{label}": (col(target) == F.lit(t)).cast("int") for t, label in others.items()}
    for label in others.values():
        for feature in features:
            out[f"{feature}_x_{label}"] = number(feature) * out[f"is_{label}"]
    return out


def target_context(
    base: DataFrame,
    features: Sequence[str],
    labels: Mapping[str, str],
    reference: str,
    keys: Sequence[str] = registry.KEYS,
) -> DataFrame:
    """Return keys with target indicators and target-by-feature products."""
    require_columns(base, [*keys, *features], "base feature table")
    columns = context_columns(features, labels, reference)
    return base.select(*[col(k) for k in keys], *[c.alias(n) for n, c in columns.items()])


def observed_context(
    table: DataFrame, features: Sequence[str], labels: Mapping[str, str], reference: str
) -> DataFrame:
    """As ``target_context``, for whatever targets a pooled table holds; checks them against the labels."""
    targets = [r[0] for r in table.select("target").distinct().limit(len(labels) + 1).collect()]
    if reference not in targets:
        raise ValueError(f"reference_target must exist in the table, got {reference!r}; available: {sorted(targets)}")
    unlabelled = sorted(t for t in targets if t not in labels)
    if unlabelled:
        raise ValueError(f"labels are missing targets: {unlabelled}")
    return target_context(table, features, {t: labels[t] for t in labels if t in targets}, reference)


class FeatureStore:
    """All feature families of one class of targets, each defined once and shared by every comparison.

    Tables are lazy. A comparison that asks for three families gets one projection of the shared wide table rather than
    three joins.
    """

    def __init__(
        self,
        predictions: DataFrame,
        target_class: str,
        targets: Sequence[str],
        descriptors: DataFrame | None = None,
        has_spread: bool = True,
        strategy: str = "auto",
    ):
        self.target_class = target_class
        self.targets = list(targets)
        self.descriptors = descriptors
        self.has_spread = has_spread
        self.predictions = predictions.where(col("target").isin(self.targets))
        self.strategy = strategy
        self._methods: dict[bool, DataFrame] = {}

    def _family_of(self, request: Mapping) -> str:
        family = request["feature_set"]
        if family not in registry.FEATURE_FAMILIES:
            raise ValueError(f"Unknown feature_set: {family}")
        if request.get("source", "auto") not in {"auto", "shared"}:
            raise ValueError("source-native feature sets support only 'auto' or 'shared'")
        return family

    def _bases(self, families: set[str]) -> DataFrame:
        """Join the physical tables that hold the families."""
        parts = []
        if families & {"method_scores", "method_ranks", "method_rank_summary"}:
            ranks = bool(families & {"method_ranks", "method_rank_summary"})
            if ranks not in self._methods:
                table = method_table(self.predictions, ranks=ranks, strategy=self.strategy)
                self._methods[ranks] = add_rank_summary(table) if ranks else table
            parts.append(self._methods[ranks])
        if "glide_uncertainty" in families:
            if not self.has_spread:
                raise ValueError(f"{registry.SPREAD_METHOD} prediction table is missing {registry.SPREAD_SOURCE_COLUMN}")
            parts.append(spread_feature(self.predictions))
        if "chemical_descriptors" in families:
            if self.descriptors is None:
                raise ValueError("chemical_descriptors were requested without a descriptor table")
            parts.append(self.descriptors)
        table = parts[0]
        for part in parts[1:]:
            table = table.join(part, list(registry.KEYS), "inner")
        return table

    def features(self, requests: Sequence[Mapping]) -> DataFrame:
        """Return keys and the columns of the requested families over key-complete rows."""
        if not requests:
            raise ValueError("feature_requests must contain at least one feature request")
        families = set()
        for request in requests:
            family = self._family_of(request)
            if family == "target_context":
                base = request.get("base_feature_set")
                if base is None:
                    raise ValueError("target_context requires base_feature_set")
                if base == "target_context":
                    raise ValueError("target_context cannot use itself as base_feature_set")
                if base not in registry.FEATURE_FAMILIES:
                    raise ValueError(f"Unknown feature_set: {base}")
                families.add(base)
            else:
                families.add(family)
        table = self._bases(families)
        out: dict[str, Column] = {}
        for request in requests:
            family = self._family_of(request)
            if family == "target_context":
                base = request.get("feature_columns") or registry.FEATURE_FAMILIES[request["base_feature_set"]]
                require_columns(table, base, request["base_feature_set"], kind="requested")
                offered = context_columns(
                    base,
                    registry.target_labels(self.target_class),
                    registry.reference_target(self.target_class),
                )
            else:
                offered = {c: col(c) for c in table.columns if c not in registry.KEYS}
            wanted = request.get("columns")
            if wanted is None:
                wanted = list(offered) if family == "target_context" else registry.FEATURE_FAMILIES[family]
            missing = [c for c in wanted if c not in offered and c not in registry.KEYS]
            if missing:
                raise ValueError(f"{family} table is missing requested column(s): {missing}")
            out.update({c: offered[c] for c in wanted if c not in registry.KEYS})
        return table.select("id", "target", *[c.alias(n) for n, c in out.items()])
