"""Follow a learner's trial trace while it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaysift.operators.metrics import higher_is_better
from assaysift.operators.tuning import TRACE_SCHEMA

CANDIDATE = ["selection_scope", "comparison_name", "model_type", "p"]


def trace_stream(spark: SparkSession, trace_path: str) -> DataFrame:
    """Return the append-only trace directory as a stream of trials."""
    return spark.readStream.schema(TRACE_SCHEMA).option("header", True).option("escape", '"').csv(trace_path)


def best_so_far(trials: DataFrame, metric: str = "spearman") -> DataFrame:
    """Return, per candidate and scope, trials seen and the best score; state is one row per candidate and scope."""
    best = F.max("tuning_score") if higher_is_better(metric) else F.min("tuning_score")
    return trials.groupBy(*CANDIDATE).agg(F.count(F.lit(1)).alias("trials"), best.alias("best_tuning_score_so_far"))
