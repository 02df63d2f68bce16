"""Connected components by shuffles alone: labels spread over edges and jump along labels until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for edges (a, b); a row per node that has an edge.

    Each round a node takes the least label among its neighbours' and its own, then the label of that label, so the
    rounds grow with the logarithm of a component's width. Every round's labels are a table in the shared folder.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component")), "labels")
    while True:
        spread = both.join(labels.select(F.col("node").alias("near"), "component"), "near").groupBy("node").agg(F.min("component").alias("seen"))
        lower = labels.join(spread, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        parent = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = stored(lower.join(parent, "component").select("node", "old", F.least("component", "above").alias("component")), "labels")
        changed = jumped.where(F.col("old") != F.col("component")).limit(1).count()
        discard(labels)
        labels = jumped.select("node", "component")
        labels._stored_at = jumped._stored_at
        if not changed:
            discard(both)
            return labels
