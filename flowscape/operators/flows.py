"""Packets to canonical bidirectional flows: keys, sessions, TCP facts, patterns.

No window or buffer holds a flow.  What depends on order (first packet, first plain SYN, first SYN-ACK of the responder) is a
least by packet index, aggregated on the map side and joined back; the joins can be split, so an elephant flow
is no single task's.  Sessions by inactivity are counted in blocks of the capture and the blocks of a key put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import ip4, packed
from ..sources.store import cut

KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]
SYN, ACK, RST = 2, 16, 4


def _has(bit: int) -> Column:
    return F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(bit) != 0


def with_key(packets: DataFrame) -> DataFrame:
    """Direction-independent key: endpoints ordered by (address bytes, port), for both IP versions.
    A packet whose addresses are of two versions is an error.  Packets may bring the numbers of their addresses
    (``src_n``, ``dst_n``); texts that are no address and have no number order as texts."""
    rows = packets
    for number, text in (("src_n", "src_ip"), ("dst_n", "dst_ip")):
        rows = rows.withColumn(number, F.coalesce(F.col(number), ip4(F.col(text))) if number in packets.columns else ip4(F.col(text)))
    # IPv4 numbers order as their bytes; only where one is missing are both packed.
    both = F.col("src_n").isNotNull() & F.col("dst_n").isNotNull()
    src, dst = packed(F.col("src_ip")), packed(F.col("dst_ip"))
    mixed = F.length(src) != F.length(dst)
    texts = (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port")))
    ports = (F.col("src_port") < F.col("dst_port")) | ((F.col("src_port") == F.col("dst_port")) & (F.col("src_ip") <= F.col("dst_ip")))
    by_number = (F.col("src_n") < F.col("dst_n")) | ((F.col("src_n") == F.col("dst_n")) & ports)
    by_bytes = F.when(mixed, F.raise_error(F.lit("a packet mixes IP versions")).cast("boolean")).otherwise((src < dst) | ((src == dst) & ports))
    rows = rows.withColumn("first", F.when(both, by_number).otherwise(F.coalesce(by_bytes, texts)))
    ends = (("lo_ip", "src_ip", "dst_ip"), ("lo_port", "src_port", "dst_port"), ("hi_ip", "dst_ip", "src_ip"), ("hi_port", "dst_port", "src_port"))
    return rows.select("*", *[F.when(F.col("first"), F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in ends]).drop("first")


#: Packets of the capture in a block of the session count.
BLOCK = 100_000


def sessions(keyed: DataFrame, timeout_s: float | None) -> DataFrame:
    """Adds ``segment``: a gap strictly over the timeout, in capture order, starts a new one.

    Gaps inside a block of the capture are found there; between the blocks of a key only the
    last and first timestamps matter."""
    if timeout_s is None:
        return keyed.withColumn("segment", F.lit(0).cast("long"))
    rows = keyed.withColumn("block", F.floor(F.col("packet_index") / BLOCK))
    w = Window.partitionBy(*KEY, "block").orderBy("packet_index")
    fresh = F.coalesce(F.col("ts") - F.lag("ts").over(w) > timeout_s, F.lit(False)).cast("long")
    rows = rows.withColumn("fresh", fresh).withColumn("inner", F.sum("fresh").over(w))
    blocks = rows.groupBy(*KEY, "block").agg(F.min_by("ts", "packet_index").alias("first_ts"), F.max_by("ts", "packet_index").alias("last_ts"), F.sum("fresh").alias("fresh"))
    run = Window.partitionBy(*KEY).orderBy("block")
    gap = F.coalesce(F.col("first_ts") - F.lag("last_ts").over(run) > timeout_s, F.lit(False)).cast("long")
    blocks = blocks.withColumn("gap", gap).withColumn("before", F.sum(F.col("gap") + F.col("fresh")).over(run) - F.col("fresh"))
    blocks = cut(blocks.select(*KEY, "block", "before"), "session-blocks")
    return rows.join(blocks, [*KEY, "block"]).withColumn("segment", F.col("before") + F.col("inner")).drop("block", "fresh", "inner", "before")


def build_flows(packets: DataFrame, timeout_s: float | None = None) -> DataFrame:
    """One row a flow; flow_id is the index of its first packet, which orders flows as captured."""
    ip_bytes = F.col("ip_bytes") if "ip_bytes" in packets.columns else F.lit(None).cast("long")
    rows = sessions(with_key(packets.where(F.col("protocol").isin(6, 17)).withColumn("ip_bytes", ip_bytes)), timeout_s)
    parts = [*KEY, "segment"]
    tcp = F.col("protocol") == 6
    plain = tcp & _has(SYN) & ~_has(ACK)
    synack = tcp & _has(SYN) & _has(ACK)
    end = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"), F.col("src_n").alias("n"), F.col("dst_n").alias("on"), F.col("dst_ip").alias("oip"), F.col("dst_port").alias("oport"), F.col("ts").alias("ts"), F.col("packet_index").alias("at"))
    heads = rows.groupBy(*parts).agg(F.min_by(end, "packet_index").alias("first"), F.min_by(end, F.when(plain, F.col("packet_index"))).alias("init"))
    rows = rows.join(cut(heads, "flow-heads"), parts)
    after = F.col("init").isNotNull() & (F.col("packet_index") >= F.col("init.at")) & tcp
    mine = (F.col("src_ip") == F.col("init.ip")) & (F.col("src_port") == F.col("init.port"))
    rows = rows.withColumn("by_init", after & mine).withColumn("by_resp", after & ~mine)
    answers = rows.where(F.col("by_resp") & synack).groupBy(*parts).agg(F.min_by(F.struct("ts", "packet_index"), "packet_index").alias("sa"))
    rows = rows.join(cut(answers, "flow-answers"), parts, "left")
    from_src = (F.col("src_ip") == F.col("first.ip")) & (F.col("src_port") == F.col("first.port"))
    late_ack = F.col("by_init") & _has(ACK) & ~_has(SYN) & ~_has(RST) & (F.col("packet_index") > F.col("sa.packet_index")) & (F.col("ts") >= F.col("sa.ts"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    first_ts = lambda c: F.min_by("ts", F.when(c, F.col("packet_index")))
    flows = rows.groupBy(*parts).agg(
        F.min("packet_index").alias("flow_id"), F.first("first").alias("first"), F.first("init").alias("init"),
        F.min_by("ts", "packet_index").alias("start_time"), F.max_by("ts", "packet_index").alias("end_time"),
        F.count(F.lit(1)).alias("packet_count"), F.sum("frame_bytes").alias("byte_count"), F.sum("payload_bytes").alias("transport_payload_byte_count"), F.sum("ip_bytes").alias("ip_byte_count"),
        count(from_src).alias("packets_from_src"), count(~from_src).alias("packets_from_dst"),
        F.sum(F.when(from_src, F.col("frame_bytes")).otherwise(0)).alias("bytes_from_src"), F.sum(F.when(~from_src, F.col("frame_bytes")).otherwise(0)).alias("bytes_from_dst"),
        count(tcp & _has(SYN)).alias("syn_count"), count(synack).alias("syn_ack_count"), count(tcp & _has(ACK)).alias("ack_count"), count(tcp & _has(RST)).alias("rst_count"),
        count(F.col("by_init") & plain).alias("syn_from_initiator"), count(F.col("by_resp") & plain).alias("syn_from_responder"),
        count(F.col("by_init") & synack).alias("synack_from_initiator"), count(F.col("by_resp") & synack).alias("synack_from_responder"),
        count(F.col("by_init") & _has(RST)).alias("rst_from_initiator"), count(F.col("by_resp") & _has(RST)).alias("rst_from_responder"),
        first_ts(F.col("by_resp") & synack).alias("first_responder_synack_time"), first_ts(F.col("by_resp") & _has(RST)).alias("first_responder_rst_time"), first_ts(F.col("by_init") & _has(RST)).alias("first_initiator_rst_time"),
        F.bool_or(F.coalesce(late_ack, F.lit(False))).alias("ack_after_synack_observed"), F.bool_or(F.coalesce(F.col("by_resp") & ~plain, F.lit(False))).alias("non_syn_response_observed"),
        F.bool_or(tcp & (F.col("payload_bytes") > 0)).alias("transport_payload_observed"),
    )
    flows = flows.select(
        "flow_id", "protocol", F.col("first.ip").alias("src_ip"), F.col("first.port").alias("src_port"), F.col("first.oip").alias("dst_ip"), F.col("first.oport").alias("dst_port"), F.col("first.n").alias("src_n"), F.col("first.on").alias("dst_n"),
        *[c for c in flows.columns if c not in (*parts, "flow_id", "first", "init")],
        F.col("init.ip").alias("initial_syn_sender_ip"), F.col("init.port").alias("initial_syn_sender_port"), F.col("init.oip").alias("initial_syn_receiver_ip"), F.col("init.oport").alias("initial_syn_receiver_port"), F.col("init.ts").alias("first_syn_time"),
    )
    flows = flows.withColumn("ip_version", F.when(F.col("src_n").isNotNull(), 4).otherwise(6)).withColumn("frame_byte_count", F.col("byte_count"))
    return flows.withColumn("duration", F.col("end_time") - F.col("start_time")).withColumn("observed_tcp_pattern", pattern())


def pattern() -> Column:
    """none, syn_to_rst, syn_synack_rst or syn_only_observed, in that precedence."""
    c = F.col
    to_rst = (c("syn_from_initiator") > 0) & (c("rst_from_responder") > 0) & (c("first_syn_time") <= c("first_responder_rst_time"))
    sa_rst = (c("syn_from_initiator") > 0) & (c("synack_from_responder") > 0) & (c("rst_from_initiator") > 0) & (c("first_syn_time") <= c("first_responder_synack_time")) & (c("first_responder_synack_time") <= c("first_initiator_rst_time"))
    only = c("initial_syn_sender_ip").isNotNull() & (c("syn_from_initiator") > 0) & (c("synack_from_responder") == 0) & (c("rst_from_responder") == 0) & ~c("non_syn_response_observed")
    return F.when((c("protocol") != 6) | c("transport_payload_observed"), "none").when(to_rst, "syn_to_rst").when(sa_rst, "syn_synack_rst").when(only, "syn_only_observed").otherwise("none")


def numbered(flows: DataFrame) -> DataFrame:
    """flow_id becomes the 1-based rank of the flow's first packet: a range sort, counts a partition and
    one offset each, so no task sees all flows."""
    spark = flows.sparkSession
    dealt = flows.repartitionByRange("flow_id").sortWithinPartitions("flow_id").withColumn("part", F.spark_partition_id())
    sizes = {r.part: r.n for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    offset = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part int, offset long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("flow_id"))
    return dealt.join(offset, "part").withColumn("flow_id", F.col("offset") + place).drop("part", "offset")


def between(packets: DataFrame, start: float, end: float) -> DataFrame:
    """The packets of [start, end), in capture order."""
    return packets.where((F.col("ts") >= start) & (F.col("ts") < end)).orderBy("packet_index")
