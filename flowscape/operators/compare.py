"""Comparison of populations: sampled curves, set overlaps, equality proofs, sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sampled_ecdf(curves: DataFrame, keys: list[str], max_points: int) -> DataFrame:
    """Rows of exact curves (keys, packet_count, cumulative_count, total_flow_count) kept for display:
    the points i * (count - 1) // (max_points - 1), with the error bound of what lies between them."""
    part = Window.partitionBy(*keys)
    order = part.orderBy("packet_count")
    rows = curves.withColumn("place", F.row_number().over(order) - 1).withColumn("points", F.count(F.lit(1)).over(part))
    # A place is kept if some i lands on it: the least i that reaches it must land there.
    step = F.lit(max_points - 1)
    least = F.ceil(F.col("place") * step / (F.col("points") - 1))
    lands = F.floor(least * (F.col("points") - 1) / step) == F.col("place")
    kept = rows.where((F.col("points") <= max_points) | lands)
    jump = F.lead("cumulative_count").over(order) - F.col("cumulative_count")
    kept = kept.withColumn("jump", F.when(F.col("points") > max_points, F.coalesce(jump, F.lit(0))).otherwise(0))
    kept = kept.withColumn("error_bound", F.max("jump").over(part) / F.col("total_flow_count"))
    return kept.select(*keys, "packet_count", "cumulative_count", "total_flow_count", F.col("points").alias("exact_points"), "error_bound")


def curve_points(n_curves: int, budget: int = 200_000, most: int = 200) -> int:
    """Points of each curve so that all stay within the budget."""
    return max(2, min(most, budget // max(1, n_curves)))


def set_overlap(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two one-column sets -> common, a_only, b_only, jaccard (null if both are empty)."""
    column = one.columns[0]
    both = one.distinct().withColumn("a", F.lit(1)).join(other.distinct().withColumn("b", F.lit(1)), column, "full_outer")
    out = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("b").isNull()).alias("a_only"), F.count_if(F.col("a").isNull()).alias("b_only"))
    return out.withColumn("jaccard", F.round(F.try_divide(F.col("common"), F.col("common") + F.col("a_only") + F.col("b_only")), 9))


def presence(one: DataFrame, other: DataFrame) -> DataFrame:
    """Each member of two sets with common, a_only or b_only."""
    column = one.columns[0]
    both = one.distinct().withColumn("a", F.lit(1)).join(other.distinct().withColumn("b", F.lit(1)), column, "full_outer")
    return both.select(column, F.when(F.col("b").isNull(), "a_only").when(F.col("a").isNull(), "b_only").otherwise("common").alias("presence"))


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of one that the other lacks and the reverse, as multisets: one row (missing, extra)."""
    missing, extra = one.exceptAll(other), other.select(*one.columns).exceptAll(one)
    return missing.agg(F.count(F.lit(1)).alias("missing")).crossJoin(F.broadcast(extra.agg(F.count(F.lit(1)).alias("extra"))))  # one row each


def without(members: DataFrame, prefix: str) -> DataFrame:
    """flow ids of the union after one prefix is left out; flows shared with another prefix survive."""
    return members.where(F.col("analysis_prefix") != prefix).select("flow_id").distinct()
