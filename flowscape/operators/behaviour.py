"""Behaviour of each address inside a prefix, and the ports it used or met.

Every member flow gives an event for each of its endpoints inside the prefix.  Rows are the addresses that sent
anything in the Raw population, with one row for each of Raw, removed and retained, zeros included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUPS = ("Raw", "removed", "retained")

#: Additive metrics of one endpoint, as SQL over the flow's columns; role is 0 for the initial SYN's sender, 1 for its
#: receiver, null without one.  {me}/{you} are src/dst or dst/src.
METRICS = {
    "flow_count": "1",
    "sent_packets": "packets_from_{me}",
    "received_packets": "packets_from_{you}",
    "sent_frame_bytes": "bytes_from_{me}",
    "received_frame_bytes": "bytes_from_{you}",
    "tcp_flow_count": "CASE WHEN protocol = 6 THEN 1 ELSE 0 END",
    "udp_flow_count": "CASE WHEN protocol = 17 THEN 1 ELSE 0 END",
    "tcp_sent_packets": "CASE WHEN protocol = 6 THEN packets_from_{me} ELSE 0 END",
    "udp_sent_packets": "CASE WHEN protocol = 17 THEN packets_from_{me} ELSE 0 END",
    "tcp_received_packets": "CASE WHEN protocol = 6 THEN packets_from_{you} ELSE 0 END",
    "udp_received_packets": "CASE WHEN protocol = 17 THEN packets_from_{you} ELSE 0 END",
    "plain_syn_sent_count_observed_post_init": "CASE role WHEN 0 THEN syn_from_initiator WHEN 1 THEN syn_from_responder ELSE 0 END",
    "synack_sent_count_observed_post_init": "CASE role WHEN 0 THEN synack_from_initiator WHEN 1 THEN synack_from_responder ELSE 0 END",
    "rst_sent_count_observed_post_init": "CASE role WHEN 0 THEN rst_from_initiator WHEN 1 THEN rst_from_responder ELSE 0 END",
    "tcp_syn_attempt_flows": "CASE WHEN protocol = 6 AND initial_syn_sender_ip = {me}_ip THEN 1 ELSE 0 END",
    "tcp_syn_receiver_flows": "CASE WHEN protocol = 6 AND initial_syn_receiver_ip = {me}_ip THEN 1 ELSE 0 END",
    "tcp_synack_response_flows": "CASE WHEN role = 1 AND synack_from_responder > 0 THEN 1 ELSE 0 END",
    "tcp_rst_response_flows": "CASE WHEN role = 1 AND rst_from_responder > 0 THEN 1 ELSE 0 END",
    "tcp_payload_observed_flows": "CASE WHEN protocol = 6 AND transport_payload_observed THEN 1 ELSE 0 END",
}
#: Metrics of a flow whose two endpoints are one address that are summed over its sides; of the others the greater counts.
SUMMED = {"sent_packets", "received_packets", "sent_frame_bytes", "received_frame_bytes", "tcp_sent_packets", "udp_sent_packets", "tcp_received_packets", "udp_received_packets", "plain_syn_sent_count_observed_post_init", "synack_sent_count_observed_post_init", "rst_sent_count_observed_post_init"}
ROLE = "CASE WHEN initial_syn_sender_ip IS NULL THEN NULL WHEN initial_syn_sender_ip = {me}_ip AND initial_syn_sender_port = {me}_port THEN 0 ELSE 1 END"
NAMED_ROLE = "CASE WHEN protocol <> 6 THEN 'first_packet_{kind}' WHEN role = 0 THEN 'syn_sender' WHEN role = 1 THEN 'syn_receiver' ELSE 'unknown' END"


def _sides(flows: DataFrame, members: DataFrame, columns) -> DataFrame:
    """One row a member flow and endpoint inside the prefix; columns(me, you) -> SQL expressions."""
    rows = flows.join(members.select("flow_id", "analysis_prefix", "src_match", "dst_match"), "flow_id")
    out = None
    for me, you in (("src", "dst"), ("dst", "src")):
        side = rows.where(f"{me}_match").withColumn("role", F.expr(ROLE.format(me=me)))
        side = side.selectExpr("analysis_prefix", f"{me}_ip AS ip", "flow_id", "broad_removed", "protocol", f"{you}_ip AS peer", *columns(me, you))
        out = side if out is None else out.unionByName(side)
    return out


def events(flows: DataFrame, members: DataFrame) -> DataFrame:
    """One row a prefix, address and flow with its metrics; a flow between an address and itself is one."""
    sides = _sides(flows, members, lambda me, you: [f"CAST({x.format(me=me, you=you)} AS BIGINT) AS {n}" for n, x in METRICS.items()])
    each = [(F.sum if n in SUMMED else F.max)(n).alias(n) for n in METRICS]
    return sides.groupBy("analysis_prefix", "ip", "flow_id").agg(F.first("broad_removed").alias("broad_removed"), F.first("protocol").alias("protocol"), F.first("peer").alias("peer"), *each)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("grp", F.explode(F.array(F.lit("Raw"), F.when(F.col("broad_removed"), "removed").otherwise("retained"))))


def address_behaviour(flows: DataFrame, members: DataFrame) -> DataFrame:
    """analysis_prefix, ip, grp, the additive metrics and three distinct peer counts."""
    rows = events(flows, members)
    cohort = rows.groupBy("analysis_prefix", "ip").agg(F.sum("sent_packets").alias("sent")).where("sent > 0").drop("sent")
    wanted = cohort.withColumn("grp", F.explode(F.array(*map(F.lit, GROUPS))))
    peer = lambda p: F.countDistinct(F.when(F.col("protocol") == p, F.col("peer")))
    sums = _grouped(rows).groupBy("analysis_prefix", "ip", "grp").agg(*[F.sum(n).alias(n) for n in METRICS], F.countDistinct("peer").alias("unique_peer_ips"), peer(6).alias("unique_tcp_peer_ips"), peer(17).alias("unique_udp_peer_ips"))
    return wanted.join(sums, ["analysis_prefix", "ip", "grp"], "left").fillna(0)


def address_ports(flows: DataFrame, members: DataFrame) -> DataFrame:
    """analysis_prefix, ip, grp, protocol, port_side, observed_role, port, flow_count, sent_packets."""
    kind = {"src": "sender", "dst": "receiver"}
    sides = _sides(flows, members, lambda me, you: [f"packets_from_{me} AS sent", f"{NAMED_ROLE.format(kind=kind[me])} AS observed_role", f"{me}_port AS local", f"{you}_port AS peer_port"])
    ports = sides.select("*", F.explode(F.array(F.struct(F.lit("local").alias("port_side"), F.col("local").alias("port")), F.struct(F.lit("peer").alias("port_side"), F.col("peer_port").alias("port")))).alias("p")).select("*", "p.*")
    key = ["analysis_prefix", "ip", "protocol", "port_side", "observed_role", "port"]
    once = ports.groupBy(*key, "flow_id").agg(F.first("broad_removed").alias("broad_removed"), F.sum("sent").alias("sent"))
    cohort = sides.groupBy("analysis_prefix", "ip").agg(F.sum("sent").alias("s")).where("s > 0").drop("s")
    return _grouped(once.join(cohort, ["analysis_prefix", "ip"], "left_semi")).groupBy(*key, "grp").agg(F.count(F.lit(1)).alias("flow_count"), F.sum("sent").alias("sent_packets"))


def top_ports(ports: DataFrame, k: int) -> DataFrame:
    """The k ports of each address, group, protocol and side by packets sent, flows, port and role, with what was left out."""
    key = ["analysis_prefix", "ip", "grp", "protocol", "port_side"]
    part = Window.partitionBy(*key)
    order = part.orderBy(F.desc("sent_packets"), F.desc("flow_count"), "port", "observed_role")
    ranked = ports.withColumn("place", F.row_number().over(order)).withColumn("total_keys", F.count(F.lit(1)).over(part)).withColumn("endpoint_flow_count", F.sum("flow_count").over(part))
    return ranked.where(F.col("place") <= k).withColumn("omitted_keys", F.greatest(F.col("total_keys") - k, F.lit(0)))


def not_additive(rows: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """Keys and metrics for which Raw is not removed plus retained; empty if all is well."""
    long = rows.select(*key, "grp", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("v")) for m in metrics])).alias("m")).select(*key, "grp", "m.*")
    signed = F.sum(F.when(F.col("grp") == "Raw", F.col("v")).otherwise(-F.col("v")))
    return long.groupBy(*key, "metric").agg(signed.alias("difference")).where("difference <> 0")


def bound_violations(counts: DataFrame) -> DataFrame:
    """counts(target, capacity, flows, raw/removed/retained endpoints and senders): rows that break
    senders <= endpoints <= min(capacity, 2 flows) or max(parts) <= raw <= sum(parts)."""
    ok = (F.col("raw_senders") <= F.col("raw_endpoints")) & (F.col("raw_endpoints") <= F.least(F.col("capacity"), 2 * F.col("flows")))
    ok = ok & (F.greatest("removed_endpoints", "retained_endpoints") <= F.col("raw_endpoints")) & (F.col("raw_endpoints") <= F.col("removed_endpoints") + F.col("retained_endpoints"))
    return counts.where(~ok)
