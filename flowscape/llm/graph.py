"""Connected components of an edge table, as joins and aggregates over saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(a, b) -> (node, label): label is the least id of the node's component.

    Each round takes the least label among neighbours and then the label's own label
    (pointer jumping), so rounds grow with the logarithm of the longest chain.  Self loops and
    repeated edges are harmless; no edges give no rows."""
    both = save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = save(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("label")), "cc-labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        step = save(step, "cc-step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = save(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old"), "cc-labels")
        changed = after.where(F.col("label") != F.col("old")).limit(1).count()
        drop_saved(labels)
        drop_saved(step)
        labels = after
        if not changed:
            return labels.select("node", "label")
    raise RuntimeError("components did not settle")
