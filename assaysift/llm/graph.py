"""Connected components by contraction, entirely in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaysift.session import reliable_checkpoint


def _roots(parent: DataFrame) -> DataFrame:
    """Follow ``parent`` (node, up), where ``up`` is smaller than its node, to the top of each tree."""
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = parent.join(above, "up", "left").select(
            "node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")
        )
        jumped = reliable_checkpoint(jumped)
        parent = jumped.select("node", "up")
        if jumped.filter("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """Return (node, component) for every end of ``edges`` (a, b): the smallest node that can be reached.

    Each round hooks every node below a smaller neighbour, collapses the trees by pointer jumping and contracts the
    edges, so even a path of any length takes a few rounds. A node with very many edges only ever meets a map-side
    combined minimum or a join side that adaptive execution splits. Null ends, loops and repeated edges are ignored,
    except that both ends of a loop are still listed. Edges are stored first, so what leads to them runs once.
    """
    edges = reliable_checkpoint(edges.select("a", "b"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    current = reliable_checkpoint(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low")).distinct()
    )
    label = ends.select("node", F.col("node").alias("component"))
    while not current.isEmpty():
        root = _roots(reliable_checkpoint(current.groupBy("node").agg(F.min("low").alias("up"))))
        label = label.join(root.withColumnRenamed("node", "component"), "component", "left").select(
            "node", F.coalesce("up", "component").alias("component")
        )
        high = root.withColumnRenamed("up", "high")
        low = root.select(F.col("node").alias("low"), F.col("up").alias("lower"))
        moved = (
            current.join(high, "node")
            .join(low, "low", "left")
            .select(F.col("high").alias("x"), F.coalesce("lower", "low").alias("y"))
        )
        current = reliable_checkpoint(
            moved.filter("x <> y").select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("low")).distinct()
        )
    return reliable_checkpoint(label)
