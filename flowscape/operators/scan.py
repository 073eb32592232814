"""Sliding source windows, scan-like labels, inclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = ("syn_to_rst", "syn_synack_rst")
BROAD = (*STRICT, "syn_only_observed")


def qualifying(flows: DataFrame) -> DataFrame:
    need = ["initial_syn_sender_ip", "initial_syn_receiver_ip", "initial_syn_receiver_port", "first_syn_time"]
    return flows.where(F.col("protocol") == 6).dropna(subset=need)


def _facts(grouped) -> DataFrame:
    target = F.struct("initial_syn_receiver_ip", "initial_syn_receiver_port")
    is_ = lambda *p: F.col("observed_tcp_pattern").isin(*p)
    return grouped.agg(
        F.count(F.lit(1)).alias("syn_initiated_flow_count"), F.countDistinct(target).alias("unique_targets"),
        F.countDistinct("initial_syn_receiver_ip").alias("unique_receiver_ips"), F.countDistinct("initial_syn_receiver_port").alias("unique_receiver_ports"),
        F.count_if(is_("syn_to_rst")).alias("syn_to_rst_count"), F.count_if(is_("syn_synack_rst")).alias("syn_synack_rst_count"), F.count_if(is_("syn_only_observed")).alias("no_response_count"),
        F.countDistinct(F.when(is_("syn_to_rst"), target)).alias("syn_to_rst_unique_targets"), F.count_if(is_(*STRICT)).alias("high_confidence_count"), F.countDistinct(F.when(is_(*STRICT), target)).alias("high_confidence_unique_targets"),
    )


def scan_windows(flows: DataFrame, size_s: float, step_s: float, anchor_s: float) -> DataFrame:
    """Windows [anchor + i*step, + size), i >= 0, of each sender; only active ones."""
    t = F.col("first_syn_time") - anchor_s
    low = F.greatest(F.lit(0).cast("long"), F.floor((t - size_s) / step_s).cast("long") + 1)
    rows = qualifying(flows).where(t >= 0).withColumn("i", F.explode(F.sequence(low, F.floor(t / step_s).cast("long"))))
    rows = rows.withColumn("window_start", anchor_s + F.col("i") * F.lit(step_s)).withColumn("window_end", F.col("window_start") + size_s)
    return _facts(rows.where((F.col("first_syn_time") >= F.col("window_start")) & (F.col("first_syn_time") < F.col("window_end"))).groupBy("initial_syn_sender_ip", "window_start", "window_end"))


def scan_summary(flows: DataFrame) -> DataFrame:
    return _facts(qualifying(flows).groupBy("initial_syn_sender_ip"))


def strict_windows(windows: DataFrame, n: int = 3, m: int = 2) -> DataFrame:
    return windows.withColumn("strict_scan_like", (F.col("syn_synack_rst_count") >= 1) | ((F.col("syn_to_rst_count") >= n) & (F.col("syn_to_rst_unique_targets") >= m)))


def scan_sources(windows: DataFrame) -> DataFrame:
    return windows.where("strict_scan_like").select("initial_syn_sender_ip").distinct()


def label_flows(flows: DataFrame, sources: DataFrame) -> DataFrame:
    """Capture-wide labels of the scan-like sources' flows."""
    hit = flows.join(sources.withColumn("hit", F.lit(True)), "initial_syn_sender_ip", "left")
    is_ = lambda *p: F.coalesce(F.col("hit"), F.lit(False)) & F.col("observed_tcp_pattern").isin(*p)
    return hit.withColumn("strict_removed", is_(*STRICT)).withColumn("broad_removed", is_(*BROAD)).drop("hit")


def threshold_sweep(windows: DataFrame, grid: list[tuple[int, int]]) -> DataFrame:
    """Strict windows and sources for each (N, M) of a small literal grid, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in grid]))
    rows = windows.withColumn("g", pairs).select("*", "g.n", "g.m")
    hit = (F.col("syn_synack_rst_count") >= 1) | ((F.col("syn_to_rst_count") >= F.col("n")) & (F.col("syn_to_rst_unique_targets") >= F.col("m")))
    return rows.groupBy("n", "m").agg(F.count_if(hit).alias("windows"), F.countDistinct(F.when(hit, F.col("initial_syn_sender_ip"))).alias("sources"))
