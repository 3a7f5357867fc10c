"""Connected components of an edge table, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of edges (a, b); the component is its smallest node.

    Each round every node takes the smallest label among its neighbours' and then that label's own label, so the rounds
    grow with the logarithm of the longest path. Labels are written to the shared folder each round.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        of = labels.select(F.col("node").alias("a"), F.col("component").alias("near"))
        near = both.join(of, "a").groupBy(F.col("b").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node", "left").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        after = step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("component"), (F.least("low", F.coalesce("lower", "low")) < F.col("component")).alias("moved"))
        after = scratch.keep(after)
        moved = after.where("moved").limit(1).count()
        labels = after.drop("moved")
        if not moved:
            return labels
