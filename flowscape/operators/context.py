"""Context of single-packet flows: packets of the same tuple and of the same source around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flows import KEY, with_key

NEAR = (1, 10, 60, 300)


def cohort(labelled: DataFrame) -> DataFrame:
    return labelled.where((F.col("packet_count") == 1) & ~F.col("broad_removed"))


def _keyed(targets: DataFrame, *more) -> DataFrame:
    """The targets' keys, by the numbers of their addresses where they have them."""
    numbers = [c for c in ("src_n", "dst_n") if c in targets.columns]
    return with_key(targets.select(*more, "src_ip", "src_port", "dst_ip", "dst_port", "protocol", *numbers))


def tuple_context(targets: DataFrame, packets: DataFrame, near: tuple[float, ...] = NEAR) -> DataFrame:
    """targets(flow_id, src/dst, protocol, start_time) against all packets of the 5-tuple.
    Packets at the target's own time count in total and direction, in neither before nor after."""
    t = _keyed(targets, "flow_id", F.col("start_time").alias("t0")).withColumnsRenamed({"src_ip": "t_ip", "src_port": "t_port"}).select("flow_id", "t0", "t_ip", "t_port", *KEY)
    rows = t.join(with_key(packets).select(*KEY, "src_ip", "src_port", "ts"), KEY).withColumn("d", F.col("ts") - F.col("t0"))
    same = (F.col("src_ip") == F.col("t_ip")) & (F.col("src_port") == F.col("t_port"))
    return rows.groupBy("flow_id", "t0").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("d") < 0).alias("before"), F.count_if(F.col("d") > 0).alias("after"), F.count_if(same).alias("forward"), F.count_if(~same).alias("reverse"),
        F.max(F.when(F.col("d") < 0, F.col("ts"))).alias("previous_ts"), F.min(F.when(F.col("d") > 0, F.col("ts"))).alias("next_ts"),
        F.max(F.when((F.col("d") < 0) & ~same, F.col("ts"))).alias("reverse_before_ts"), F.min(F.when((F.col("d") > 0) & ~same, F.col("ts"))).alias("reverse_after_ts"),
        *[F.count_if((F.col("d") < 0) & (F.col("d") >= -n)).alias(f"before_{n}s") for n in near], *[F.count_if((F.col("d") > 0) & (F.col("d") <= n)).alias(f"after_{n}s") for n in near],
    )


def observations(targets: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of all packets, those with a target's key, and the plain SYNs sent by an endpoint of a target."""
    keys = _keyed(targets).select(*KEY).distinct()
    ends = targets.select(F.col("src_ip").alias("ip")).unionByName(targets.select(F.col("dst_ip").alias("ip"))).distinct()
    plain = (F.col("protocol") == 6) & (F.col("flags").bitwiseAND(2) != 0) & (F.col("flags").bitwiseAND(16) == 0)
    return with_key(packets).join(keys, KEY, "left_semi"), packets.where(plain).join(ends.withColumnRenamed("ip", "src_ip"), "src_ip", "left_semi")


def target_matches(targets: DataFrame, packets: DataFrame) -> DataFrame:
    """flow_id, matches: packets with the target's key and exactly its timestamp; one is right, none is
    missing, more are ambiguous."""
    t = _keyed(targets, "flow_id", F.col("start_time").alias("ts")).select("flow_id", "ts", *KEY)
    hits = t.join(with_key(packets).select(*KEY, "ts", F.lit(1).alias("hit")), [*KEY, "ts"], "left")
    return hits.groupBy("flow_id").agg(F.count("hit").alias("matches"))


def checked(targets: DataFrame, packets: DataFrame) -> DataFrame:
    """The targets; an error at once where one has no match or several (a lazy one could be optimised away)."""
    wrong = target_matches(targets, packets).where("matches <> 1").orderBy("flow_id").limit(20).collect()
    if wrong:
        raise ValueError("; ".join(f"{'missing' if r.matches == 0 else 'ambiguous'} target match for flow {r.flow_id}" for r in wrong))
    return targets


#: Flag letters in the order they are written.
FLAGS = ((256, "N"), (1, "F"), (2, "S"), (4, "R"), (8, "P"), (16, "A"), (32, "U"), (64, "E"), (128, "C"))


def flag_text(flags):
    """Letters of the TCP flags; null for none."""
    return F.when(flags.isNotNull(), F.concat(*[F.when(flags.bitwiseAND(bit) != 0, letter).otherwise("") for bit, letter in FLAGS]))


def gaps(context: DataFrame) -> DataFrame:
    """tuple_context with the gaps to the previous, next and nearest reverse packets."""
    t0 = F.col("t0")
    return context.select("*", (t0 - F.col("previous_ts")).alias("previous_gap"), (F.col("next_ts") - t0).alias("next_gap"), (t0 - F.col("reverse_before_ts")).alias("reverse_before_gap"), (F.col("reverse_after_ts") - t0).alias("reverse_after_gap"))


#: The windows of the source context in seconds.
WINDOWS = {"5m": 300.0, "15m": 900.0, "1h": 3600.0, "24h": 86400.0}


def source_contexts(targets: DataFrame, syns: DataFrame, windows: dict[str, float] = WINDOWS) -> DataFrame:
    """Every target with whether it is a plain SYN and, if so, the facts of each window; null otherwise."""
    able = targets.where("initial_syn_sender_ip is not null")
    out = targets.select("flow_id", F.col("initial_syn_sender_ip").isNotNull().alias("applicable"))
    for name, seconds in windows.items():
        facts = source_context(able, syns, seconds)
        out = out.join(facts.select("flow_id", *[F.col(c).alias(f"{c}_{name}") for c in facts.columns if c != "flow_id"]), "flow_id", "left")
    return out


def cohort_hash(targets: DataFrame) -> DataFrame:
    """One row: number of distinct keys and a hash of them that doesn't depend on their order."""
    keys = _keyed(targets).select(*KEY).distinct()
    each = F.sha2(F.concat_ws("|", *KEY), 256)
    return keys.agg(F.count(F.lit(1)).alias("keys"), F.sum(F.conv(F.substring(each, 1, 8), 16, 10).cast("decimal(38,0)")).alias("digest"))


def source_context(targets: DataFrame, syns: DataFrame, window_s: float) -> DataFrame:
    """targets(flow_id, src_ip, start_time), syns(src_ip, dst_ip, dst_port, ts): plain SYNs of the
    source within |dt| <= window.  Time is bucketed by the window, so each target meets three buckets only."""
    bucket = lambda c: F.floor(F.col(c) / window_s)
    t = targets.select("flow_id", "src_ip", F.col("start_time").alias("t0")).withColumn("bucket", F.explode(F.sequence(bucket("t0") - 1, bucket("t0") + 1)))
    s = syns.select("src_ip", "dst_ip", "dst_port", "ts").withColumn("bucket", bucket("ts"))
    near = t.join(s, ["src_ip", "bucket"]).where(F.abs(F.col("ts") - F.col("t0")) <= window_s)
    return near.groupBy("flow_id").agg(F.count(F.lit(1)).alias("packets"), F.countDistinct(F.struct("dst_ip", "dst_port")).alias("unique_targets"), F.countDistinct("dst_ip").alias("unique_ips"), F.countDistinct("dst_port").alias("unique_ports"))
