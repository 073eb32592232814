"""Exact flow-size distributions: frequencies, quantiles, histograms, ECDF, KS, Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequencies(flows: DataFrame, members: DataFrame) -> DataFrame:
    """target, packet_count, broad_removed, n: every prefix, their union and all flows."""
    cols = ["packet_count", "broad_removed"]
    by = flows.join(members.select("flow_id", F.col("analysis_prefix").alias("target")), "flow_id").select("target", *cols)
    union = flows.join(members.select("flow_id").distinct(), "flow_id", "left_semi").select(F.lit("selected_union").alias("target"), *cols)
    overall = flows.select(F.lit("overall_ipv4").alias("target"), *cols)
    return by.unionByName(union).unionByName(overall).groupBy("target", *cols).agg(F.count(F.lit(1)).alias("n"))


def conditions(freq: DataFrame) -> DataFrame:
    """Adds condition raw / removed / retained to frequency rows (each row counts in two)."""
    both = F.array(F.lit("raw"), F.when(F.col("broad_removed"), "removed").otherwise("retained"))
    return freq.withColumn("condition", F.explode(both)).groupBy("target", "condition", "packet_count").agg(F.sum("n").alias("n"))


def quantiles(cond: DataFrame) -> DataFrame:
    """Linear-interpolated quantiles straight from frequencies, totals in exact decimals."""
    q = F.percentile("packet_count", F.array(F.lit(0.5), F.lit(0.95)), F.col("n"))
    total = F.sum(F.col("packet_count").cast("decimal(38,0)") * F.col("n"))
    return cond.groupBy("target", "condition").agg(F.sum("n").alias("flows"), total.cast("double").alias("packets"), q.alias("q")).select("target", "condition", "flows", "packets", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p95"), F.try_divide("packets", F.col("flows")).alias("mean"))


def histogram(cond: DataFrame) -> DataFrame:
    """Bins 1, 2, 3, 4, 8, 16 ... until one holds the greatest value, zero bins included."""
    top = cond.agg(F.max("packet_count").alias("top"))  # one row
    edges = F.concat(F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]), F.transform(F.sequence(F.lit(2), F.greatest(F.floor(F.log2("top")).cast("int"), F.lit(2))), lambda k: F.pow(F.lit(2.0), k).cast("long")))
    bins = top.where("top is not null").select(F.explode(edges).alias("lo")).select("lo", F.when(F.col("lo") < 3, F.col("lo") + 1).when(F.col("lo") == 3, 4).otherwise(2 * F.col("lo")).alias("hi"))
    grid = cond.select("target", "condition").distinct().crossJoin(F.broadcast(bins))  # 64 rows at most
    lo = F.when(F.col("packet_count") <= 3, F.col("packet_count")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("packet_count"))).cast("long"))
    return grid.join(cond.withColumn("lo", lo).groupBy("target", "condition", "lo").agg(F.sum("n").alias("n")), ["target", "condition", "lo"], "left").fillna(0, ["n"])


def axis_upper(overall: int) -> int:
    """The power of ten above a count, for a shared axis."""
    return 10 ** len(str(overall))


def ecdf(freq: DataFrame, by: list[str]) -> DataFrame:
    """by..., packet_count, frequency, cumulative, total, fraction."""
    w = Window.partitionBy(*by)
    run = w.orderBy("packet_count").rowsBetween(Window.unboundedPreceding, 0)
    out = freq.select(*by, "packet_count", F.col("n").alias("frequency"), F.sum("n").over(run).alias("cumulative_count"), F.sum("n").over(w).alias("total_flow_count"))
    return out.withColumn("cumulative_fraction", F.col("cumulative_count") / F.col("total_flow_count"))


def ks(freq: DataFrame, by: list[str], side: str, a: str, b: str) -> DataFrame:
    """Exact Kolmogorov-Smirnov distance between two values of ``side``, null if one is empty."""
    x = freq.where(F.col(side).isin(a, b)).groupBy(*by, "packet_count").agg(*[F.sum(F.when(F.col(side) == s, F.col("n")).otherwise(0)).cast("decimal(18,0)").alias(k) for k, s in (("na", a), ("nb", b))])
    w = Window.partitionBy(*by)
    run = w.orderBy("packet_count").rowsBetween(Window.unboundedPreceding, 0)
    x = x.select(*by, F.sum("na").over(run).cast("decimal(18,0)").alias("ca"), F.sum("nb").over(run).cast("decimal(18,0)").alias("cb"), F.sum("na").over(w).cast("decimal(18,0)").alias("ta"), F.sum("nb").over(w).cast("decimal(18,0)").alias("tb"))
    top = F.max(F.abs(F.col("ca") * F.col("tb") - F.col("cb") * F.col("ta")))
    return x.groupBy(*by).agg(top.alias("top"), F.max("ta").alias("ta"), F.max("tb").alias("tb")).select(*by, F.try_divide(F.col("top").cast("double"), F.col("ta").cast("double") * F.col("tb").cast("double")).alias("ks"))


def jaccard(sets: DataFrame, key: str, names: list[str]) -> DataFrame:
    """sets(key, name): pairwise Jaccard by one bit mask a key."""
    bit = sum((F.when(F.col("name") == n, 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    masks = sets.groupBy(key).agg(F.bit_or(bit).alias("mask"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    sums = masks.agg(*[F.count_if((F.col("mask").bitwiseAND(1 << i) != 0) & (F.col("mask").bitwiseAND(1 << j) != 0)).alias(f"i{i}{j}") for i, j in pairs], *[F.count_if(F.col("mask").bitwiseAND((1 << i) | (1 << j)) != 0).alias(f"u{i}{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"i{i}{j}").alias("common"), F.col(f"u{i}{j}").alias("either")) for i, j in pairs])
    return sums.select(F.explode(rows).alias("r")).select("r.*").withColumn("jaccard", F.try_divide("common", F.col("either")))
