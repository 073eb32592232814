"""Queries on behaviour, comparison, context, captures and heavy hitters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import capacity, cidr, network
from ..operators import behaviour, compare, context, distribution, heavy, scan
from ..operators.flows import between, numbered
from ..sources import capture, wire
from ..sources.store import stored
from .catalog import ANCHOR, DOT, IP, _cond, _flows, _labelled, _members, _selected, _sql, _strict, _windows, build_labelled_timeout
from .surrogate import packets

DAY = 86400.0
#: Condition names of a flow, and the same in SQL.
KEPT = "explode(array_compact(array('raw', if(strict_removed, null, 'strict'), if(broad_removed, null, 'broad'))))"
KEPT_SQL = "unnest([x FOR x IN ['raw', CASE WHEN NOT strict_removed THEN 'strict' END, CASE WHEN NOT broad_removed THEN 'broad' END] IF x IS NOT NULL])"
QUERIES: dict = {}


def query(sql: str | None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = (f, sql)
        return f

    return add


def _in_prefix(s, d) -> DataFrame:
    return _labelled(s, d).join(_members(s, d).select("flow_id", "analysis_prefix", "src_match", "dst_match"), "flow_id")


# Flows and labels.


@query(_sql("SELECT row_number() OVER (ORDER BY flow_id) AS flow_id, src_ip, dst_ip, packet_count, 4 AS ip_version, byte_count AS frame_byte_count, (byte_count - 14 * packet_count)::BIGINT AS ip_byte_count FROM fl"))
def flows_numbered(s, d):
    return numbered(_flows(s, d)).select("flow_id", "src_ip", "dst_ip", "packet_count", "ip_version", "frame_byte_count", "ip_byte_count")


@query(_sql(f"SELECT packet_index, src_ip, src_port FROM k WHERE ts >= {ANCHOR + DAY} AND ts < {ANCHOR + 3 * DAY}"))
def packets_between(s, d):
    return between(packets(s, d), ANCHOR + DAY, ANCHOR + 3 * DAY).select("packet_index", "src_ip", "src_port")


@query(_sql("SELECT flow_id, false AS strict_scan_like, false AS broad_scan_like, false AS strict_removed, false AS broad_removed FROM fl"))
def neutral_labels(s, d):
    return _flows(s, d).select("flow_id", *[F.lit(False).alias(c) for c in ("strict_scan_like", "broad_scan_like", "strict_removed", "broad_removed")])


@query(_sql("SELECT initial_syn_sender_ip, window_start, round(high_confidence_count / syn_initiated_flow_count::DOUBLE, 9) AS ratio FROM win WHERE syn_initiated_flow_count > 0"))
def high_confidence_ratio(s, d):
    return _windows(s, d).where("syn_initiated_flow_count > 0").select("initial_syn_sender_ip", "window_start", F.round(F.col("high_confidence_count") / F.col("syn_initiated_flow_count"), 9).alias("ratio"))


@query(_sql("SELECT count(*) AS windows, count(*) FILTER (strict_scan_like) AS strict_windows, count(*) FILTER (no_response_count > 0) AS no_response_windows, count(*) FILTER (strict_scan_like AND no_response_count > 0) AS both_kinds FROM st WHERE initial_syn_sender_ip IN (SELECT initial_syn_sender_ip FROM src)"))
def strict_overlap(s, d):
    rows = _strict(s, d)
    rows = rows.join(scan.scan_sources(rows), "initial_syn_sender_ip", "left_semi")
    some = F.col("no_response_count") > 0
    return rows.agg(F.count(F.lit(1)).alias("windows"), F.count_if("strict_scan_like").alias("strict_windows"), F.count_if(some).alias("no_response_windows"), F.count_if(F.col("strict_scan_like") & some).alias("both_kinds"))


@query(_sql("SELECT 'strict' AS component, count(*) FILTER (strict_removed) AS flows FROM lab UNION ALL SELECT 'broad_additional', count(*) FILTER (broad_removed AND NOT strict_removed) FROM lab UNION ALL SELECT 'total', count(*) FILTER (broad_removed) FROM lab UNION ALL SELECT 'strict_not_broad', count(*) FILTER (strict_removed AND NOT broad_removed) FROM lab"))
def removal_components(s, d):
    strict, broad = F.col("strict_removed"), F.col("broad_removed")
    parts = {"strict": strict, "broad_additional": broad & ~strict, "total": broad, "strict_not_broad": strict & ~broad}
    one = _labelled(s, d).agg(*[F.count_if(c).alias(n) for n, c in parts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).alias("flows")) for n in parts])).alias("r")).select("r.*")


@query(_sql("SELECT count(*) FILTER (l.flow_id IS NULL) AS missing, count(*) FILTER (f.flow_id IS NULL) AS extra, count(*) - count(DISTINCT coalesce(f.flow_id, l.flow_id)) AS repeated FROM fl f FULL JOIN lab l USING (flow_id)"))
def label_identities(s, d):
    """Flow ids without a label, labels without a flow, ids that come twice: all must be 0."""
    flows, labels = _flows(s, d).select("flow_id"), _labelled(s, d).select("flow_id")
    missing = flows.join(labels, "flow_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    extra = labels.join(flows, "flow_id", "left_anti").agg(F.count(F.lit(1)).alias("extra"))
    repeated = flows.groupBy("flow_id").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeated"))
    return missing.crossJoin(F.broadcast(extra)).crossJoin(F.broadcast(repeated))  # one row each


# Membership.


@query(_sql("SELECT prefix, lo, hi FROM sel", ledger=True))
def membership_targets(s, d):
    return _selected(s, d).select("prefix", F.col("net").alias("lo"), (F.col("net") + capacity(F.col("prefix_length")) - 1).alias("hi"))


@query(_sql("SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, count(*) AS expected FROM mem", ledger=True))
def membership_proof(s, d):
    """Saved edges against edges recomputed from both endpoints' containing prefixes."""
    saved = _members(s, d).select("flow_id", "analysis_prefix", "src_match", "dst_match")
    p = _selected(s, d).select("net", F.col("prefix_length").alias("len"), F.col("prefix").alias("analysis_prefix"))
    sides = []
    for side, other in (("src", "dst"), ("dst", "src")):
        ends = _flows(s, d).select("flow_id", F.col(f"{side}_n").alias("ip"), F.explode(F.sequence(F.lit(24), F.lit(32))).alias("len"))
        hits = ends.withColumn("net", network(F.col("ip"), F.col("len"))).join(p, ["net", "len"])
        sides.append(hits.select("flow_id", "analysis_prefix", F.lit(True).alias(f"{side}_match"), F.lit(False).alias(f"{other}_match")))
    again = sides[0].unionByName(sides[1]).groupBy("flow_id", "analysis_prefix").agg(F.bool_or("src_match").alias("src_match"), F.bool_or("dst_match").alias("dst_match"))
    return compare.differences(again, saved).crossJoin(F.broadcast(again.agg(F.count(F.lit(1)).alias("expected"))))  # one row each


FOCUS = (3232235521, 3232235521)  # 192.168.0.1


@query(_sql(f"SELECT prefix FROM sel WHERE lo <= {FOCUS[0]} AND hi >= {FOCUS[1]}", ledger=True))
def covering_prefixes(s, d):
    last = F.col("net") + capacity(F.col("prefix_length")) - 1
    return _selected(s, d).where((F.col("net") <= FOCUS[0]) & (last >= FOCUS[1])).select("prefix")


# Addresses.


@query(_sql("SELECT prefix FROM sel WHERE false", ledger=True))
def host_count_violations(s, d):
    """Prefixes whose endpoint and sender counts break their bounds: none."""
    rows = behaviour.events(_labelled(s, d), _members(s, d))
    flag = lambda c: F.max(c.cast("int"))
    sent, out = F.col("sent_packets") > 0, F.col("broad_removed")
    per = rows.groupBy("analysis_prefix", "ip").agg(flag(sent).alias("s"), flag(out).alias("r"), flag(~out).alias("k"), flag(sent & out).alias("sr"), flag(sent & ~out).alias("sk"))
    counts = per.groupBy("analysis_prefix").agg(F.count(F.lit(1)).alias("raw_endpoints"), *[F.sum(c).cast("long").alias(n) for c, n in (("s", "raw_senders"), ("r", "removed_endpoints"), ("k", "retained_endpoints"), ("sr", "removed_senders"), ("sk", "retained_senders"))])
    flows = _members(s, d).groupBy("analysis_prefix").agg(F.count(F.lit(1)).alias("flows"))
    caps = _selected(s, d).select(F.col("prefix").alias("analysis_prefix"), capacity(F.col("prefix_length")).alias("capacity"))
    return behaviour.bound_violations(counts.join(flows, "analysis_prefix").join(caps, "analysis_prefix")).select(F.col("analysis_prefix").alias("prefix"))


def _sides_sql(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT analysis_prefix, {me}_ip AS ip, flow_id, broad_removed, protocol, {you}_ip AS peer, {', '.join(columns(me, you))} FROM (SELECT *, {behaviour.ROLE.format(me=me)} AS role FROM lab JOIN mem USING (flow_id) WHERE {me}_match)"
        for me, you in (("src", "dst"), ("dst", "src"))
    )


_EVENTS = ", sides AS (" + _sides_sql(lambda me, you: [f"{x.format(me=me, you=you)} AS {n}" for n, x in behaviour.METRICS.items()]) + "), ev AS (SELECT analysis_prefix, ip, flow_id, any_value(broad_removed) AS broad_removed, any_value(protocol) AS protocol, any_value(peer) AS peer, " + ", ".join(f"{'sum' if n in behaviour.SUMMED else 'max'}({n})::BIGINT AS {n}" for n in behaviour.METRICS) + " FROM sides GROUP BY 1, 2, 3), co AS (SELECT analysis_prefix, ip FROM ev GROUP BY 1, 2 HAVING sum(sent_packets) > 0), gg AS (SELECT * FROM co CROSS JOIN (VALUES ('Raw'), ('removed'), ('retained')) v(grp))"
_MATCH = "ev.analysis_prefix = gg.analysis_prefix AND ev.ip = gg.ip AND (grp = 'Raw' OR (grp = 'removed') = broad_removed)"
_BEHAVIOUR = "SELECT gg.analysis_prefix, gg.ip, gg.grp, " + ", ".join(f"coalesce(sum({n}), 0)::BIGINT AS {n}" for n in behaviour.METRICS) + f", count(DISTINCT peer) AS unique_peer_ips, count(DISTINCT CASE WHEN protocol = 6 THEN peer END) AS unique_tcp_peer_ips, count(DISTINCT CASE WHEN protocol = 17 THEN peer END) AS unique_udp_peer_ips FROM gg LEFT JOIN ev ON {_MATCH} GROUP BY 1, 2, 3"


@query(_sql(_EVENTS.removeprefix("") + " " + _BEHAVIOUR, ledger=True))
def address_behaviour(s, d):
    return stored(s, d, "behaviour", lambda: behaviour.address_behaviour(_labelled(s, d), _members(s, d)))


_KIND = {"src": "sender", "dst": "receiver"}
_PORTS = ", ps AS (" + _sides_sql(lambda me, you: [f"packets_from_{me} AS sent", f"{behaviour.NAMED_ROLE.format(kind=_KIND[me])} AS observed_role", f"{me}_port AS lport", f"{you}_port AS pport"]) + "), px AS (SELECT analysis_prefix, ip, flow_id, broad_removed, protocol, observed_role, 'local' AS port_side, lport AS port, sent FROM ps UNION ALL SELECT analysis_prefix, ip, flow_id, broad_removed, protocol, observed_role, 'peer', pport, sent FROM ps), p1 AS (SELECT analysis_prefix, ip, protocol, port_side, observed_role, port, flow_id, any_value(broad_removed) AS broad_removed, sum(sent)::BIGINT AS sent FROM px GROUP BY ALL), pc AS (SELECT analysis_prefix, ip FROM ps GROUP BY 1, 2 HAVING sum(sent) > 0), p2 AS (SELECT p1.*, grp FROM p1 JOIN pc USING (analysis_prefix, ip) CROSS JOIN (VALUES ('Raw'), ('removed'), ('retained')) v(grp) WHERE grp = 'Raw' OR (grp = 'removed') = broad_removed), pt AS (SELECT analysis_prefix, ip, protocol, port_side, observed_role, port, grp, count(*) AS flow_count, sum(sent)::BIGINT AS sent_packets FROM p2 GROUP BY ALL)"


@query(_sql(_PORTS + " SELECT * FROM pt", ledger=True))
def address_ports(s, d):
    return stored(s, d, "ports", lambda: behaviour.address_ports(_labelled(s, d), _members(s, d)))


@query(_sql(_PORTS + " SELECT analysis_prefix, ip, grp, protocol, port_side, observed_role, port, flow_count, sent_packets, row_number() OVER (w ORDER BY sent_packets DESC, flow_count DESC, port, observed_role)::INT AS place, count(*) OVER w AS total_keys, (sum(flow_count) OVER w)::BIGINT AS endpoint_flow_count, greatest(count(*) OVER w - 3, 0) AS omitted_keys FROM pt WINDOW w AS (PARTITION BY analysis_prefix, ip, grp, protocol, port_side) QUALIFY place <= 3", ledger=True))
def top_ports(s, d):
    return behaviour.top_ports(address_ports(s, d), 3).select("analysis_prefix", "ip", "grp", "protocol", "port_side", "observed_role", "port", "flow_count", "sent_packets", "place", "total_keys", "endpoint_flow_count", "omitted_keys")


@query(_sql("SELECT analysis_prefix, src_ip AS ip, '' AS metric, 0::BIGINT AS difference FROM mem JOIN lab USING (flow_id) WHERE false", ledger=True))
def behaviour_identity(s, d):
    """Additive metrics for which Raw is not removed plus retained: none."""
    return behaviour.not_additive(address_behaviour(s, d), ["analysis_prefix", "ip"], list(behaviour.METRICS))


# Summaries.

_COND2 = f"(SELECT *, {KEPT_SQL} AS condition FROM lab)"


@query(_sql(", pc AS (SELECT analysis_prefix, condition, flow_id, packet_count, byte_count FROM (SELECT *, " + KEPT_SQL + " AS condition FROM lab) l JOIN mem USING (flow_id)) SELECT x.analysis_prefix, x.condition, count(pc.flow_id) AS flows, coalesce(sum(packet_count), 0)::BIGINT AS packets, round(median(packet_count), 6) AS median_packets, round(median(byte_count), 6) AS median_bytes FROM (SELECT DISTINCT prefix AS analysis_prefix, c AS condition FROM sel CROSS JOIN (VALUES ('raw'), ('strict'), ('broad')) v(c)) x LEFT JOIN pc ON pc.analysis_prefix = x.analysis_prefix AND pc.condition = x.condition GROUP BY 1, 2", ledger=True))
def prefix_conditions(s, d):
    """Every selected prefix under every condition, zeros kept and medians null where nothing is left."""
    wanted = _selected(s, d).select(F.col("prefix").alias("analysis_prefix"), F.explode(F.array(*map(F.lit, ("raw", "strict", "broad")))).alias("condition"))
    rows = _in_prefix(s, d).withColumn("condition", F.expr(KEPT)).groupBy("analysis_prefix", "condition").agg(F.count(F.lit(1)).alias("flows"), F.sum("packet_count").alias("packets"), F.round(F.median("packet_count"), 6).alias("median_packets"), F.round(F.median("byte_count"), 6).alias("median_bytes"))
    return wanted.join(rows, ["analysis_prefix", "condition"], "left").fillna(0, ["flows", "packets"])


_CHANGE = ", ch AS (SELECT analysis_prefix, median(byte_count) AS raw_median, median(byte_count) FILTER (NOT broad_removed) AS broad_median, count(*) FILTER (broad_removed) / count(*)::DOUBLE AS removal FROM lab JOIN mem USING (flow_id) GROUP BY 1), cg AS (SELECT analysis_prefix, removal, CASE WHEN raw_median <> 0 THEN (broad_median - raw_median) / raw_median * 100 END AS change FROM ch)"


def _changes(s, d):
    rows = _in_prefix(s, d).groupBy("analysis_prefix").agg(F.median("byte_count").alias("raw"), F.median(F.when(~F.col("broad_removed"), F.col("byte_count"))).alias("broad"), (F.count_if("broad_removed") / F.count(F.lit(1))).alias("removal"))
    return rows.select("analysis_prefix", "removal", (F.try_divide(F.col("broad") - F.col("raw"), F.col("raw")) * 100).alias("change"))


@query(_sql(_CHANGE + " SELECT analysis_prefix, round(removal, 9) AS removal, round(change, 6) AS change FROM cg", ledger=True))
def median_changes(s, d):
    return _changes(s, d).select("analysis_prefix", F.round("removal", 9).alias("removal"), F.round("change", 6).alias("change"))


@query(_sql(_CHANGE + " SELECT round(corr(removal, change), 6) AS r FROM cg", ledger=True))
def removal_correlation(s, d):
    return _changes(s, d).agg(F.round(F.corr("removal", "change"), 6).alias("r"))


@query(_sql(_CHANGE + " SELECT analysis_prefix, round(change, 6) AS change, round(abs(change) / max(abs(change)) OVER (), 6) AS shade FROM cg WHERE change IS NOT NULL ORDER BY abs(round(change, 6)) DESC, analysis_prefix LIMIT 10", ledger=True))
def largest_changes(s, d):
    rows = _changes(s, d).where("change is not null")
    top = rows.agg(F.max(F.abs("change")).alias("top"))
    out = rows.crossJoin(F.broadcast(top))  # one row
    return out.select("analysis_prefix", F.round("change", 6).alias("change"), F.round(F.try_divide(F.abs("change"), F.col("top")), 6).alias("shade")).orderBy(F.desc(F.abs("change")), "analysis_prefix").limit(10)


@query(_sql(", m AS (SELECT analysis_prefix, median(packet_count) AS p FROM lab JOIN mem USING (flow_id) GROUP BY 1) SELECT round(quantile_cont(p, 0.25), 6) AS q25, round(median(p), 6) AS q50, round(quantile_cont(p, 0.75), 6) AS q75, (SELECT round(median(packet_count), 6) FROM lab) AS overall FROM m", ledger=True))
def prefix_medians(s, d):
    per = _in_prefix(s, d).groupBy("analysis_prefix").agg(F.median("packet_count").alias("p"))
    overall = _labelled(s, d).agg(F.round(F.median("packet_count"), 6).alias("overall"))
    return per.agg(*[F.round(F.percentile("p", q), 6).alias(n) for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]).crossJoin(F.broadcast(overall))  # one row each


PATTERNS = ("syn_to_rst", "syn_synack_rst", "syn_only_observed")


@query(_sql("SELECT p.name AS pattern, count(q.flow_id) AS flows, round(count(q.flow_id) / (SELECT count(*) FROM fl WHERE protocol = 6)::DOUBLE, 9) AS share FROM (VALUES ('syn_to_rst'), ('syn_synack_rst'), ('syn_only_observed'), ('other')) p(name) LEFT JOIN (SELECT flow_id, CASE WHEN observed_tcp_pattern IN ('syn_to_rst', 'syn_synack_rst', 'syn_only_observed') THEN observed_tcp_pattern ELSE 'other' END AS name FROM fl WHERE protocol = 6) q USING (name) GROUP BY 1"))
def pattern_composition(s, d):
    order = s.createDataFrame([(p,) for p in (*PATTERNS, "other")], "pattern string")
    tcp = _flows(s, d).where("protocol = 6").withColumn("pattern", F.when(F.col("observed_tcp_pattern").isin(*PATTERNS), F.col("observed_tcp_pattern")).otherwise("other"))
    counts, total = tcp.groupBy("pattern").agg(F.count(F.lit(1)).alias("flows")), tcp.agg(F.count(F.lit(1)).alias("total"))
    rows = order.join(counts, "pattern", "left").fillna(0, ["flows"]).crossJoin(F.broadcast(total))  # one row
    return rows.select("pattern", "flows", F.round(F.try_divide("flows", "total"), 9).alias("share"))


@query(_sql("SELECT observed_tcp_pattern, round(avg(byte_count), 6) AS mean_bytes, round(quantile_cont(byte_count, 0.9), 6) AS q90_bytes, round(median(duration), 4) AS median_duration, round(count(*) FILTER (transport_payload_byte_count = 0) / count(*)::DOUBLE, 9) AS zero_payload_ratio FROM fl GROUP BY 1"))
def byte_summary(s, d):
    return _flows(s, d).groupBy("observed_tcp_pattern").agg(F.round(F.avg("byte_count"), 6).alias("mean_bytes"), F.round(F.percentile("byte_count", 0.9), 6).alias("q90_bytes"), F.round(F.median("duration"), 4).alias("median_duration"), F.round(F.count_if(F.col("transport_payload_byte_count") == 0) / F.count(F.lit(1)), 9).alias("zero_payload_ratio"))


@query(_sql("SELECT analysis_prefix, CASE WHEN initial_syn_sender_ip IS NULL THEN 'unknown' WHEN src_match AND dst_match THEN 'both' WHEN (src_match AND initial_syn_sender_ip = src_ip AND initial_syn_sender_port = src_port) OR (dst_match AND initial_syn_sender_ip = dst_ip AND initial_syn_sender_port = dst_port) THEN 'sender' ELSE 'receiver' END AS role, count(*) AS flows FROM lab JOIN mem USING (flow_id) GROUP BY 1, 2", ledger=True))
def syn_roles(s, d):
    is_end = lambda e: (F.col("initial_syn_sender_ip") == F.col(f"{e}_ip")) & (F.col("initial_syn_sender_port") == F.col(f"{e}_port"))
    inside = (F.col("src_match") & is_end("src")) | (F.col("dst_match") & is_end("dst"))
    role = F.when(F.col("initial_syn_sender_ip").isNull(), "unknown").when(F.col("src_match") & F.col("dst_match"), "both").when(inside, "sender").otherwise("receiver")
    return _in_prefix(s, d).groupBy("analysis_prefix", role.alias("role")).agg(F.count(F.lit(1)).alias("flows"))


@query(_sql("SELECT floor(duration / 864000)::BIGINT AS bin, count(*) AS flows, count(*) FILTER (duration >= 10) AS ge_10 FROM fl GROUP BY 1"))
def duration_bins(s, d):
    return _flows(s, d).groupBy(F.floor(F.col("duration") / 864000).alias("bin")).agg(F.count(F.lit(1)).alias("flows"), F.count_if(F.col("duration") >= 10).alias("ge_10"))


@query(_sql("SELECT protocol, count(byte_count) AS count, round(avg(byte_count), 6) AS mean, round(stddev_samp(byte_count), 4) AS std, min(byte_count) AS min, round(quantile_cont(byte_count, 0.25), 6) AS q25, round(quantile_cont(byte_count, 0.5), 6) AS q50, round(quantile_cont(byte_count, 0.75), 6) AS q75, max(byte_count) AS max FROM fl GROUP BY 1"))
def describe_bytes(s, d):
    v = F.col("byte_count")
    return _flows(s, d).groupBy("protocol").agg(F.count(v).alias("count"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("min"), *[F.round(F.percentile(v, q), 6).alias(n) for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))], F.max(v).alias("max"))


@query(_sql(f", x AS (SELECT *, {KEPT_SQL} AS condition FROM lab), t AS (SELECT condition, count(*) AS total, count(*) FILTER (packet_count > 5) AS outside FROM x GROUP BY 1) SELECT condition, packet_count, count(*) AS flows, round(count(*) * 100 / any_value(total)::DOUBLE, 6) AS percent, any_value(outside) AS outside, round(any_value(outside) * 100 / any_value(total)::DOUBLE, 6) AS outside_percent FROM x JOIN t USING (condition) WHERE packet_count <= 5 GROUP BY 1, 2"))
def integer_distribution(s, d):
    """Flow lengths up to 5 packets, as percentages of all flows of a condition, with what lies beyond."""
    rows = _labelled(s, d).withColumn("condition", F.expr(KEPT))
    totals = rows.groupBy("condition").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("packet_count") > 5).alias("outside"))
    counts = rows.where("packet_count <= 5").groupBy("condition", "packet_count").agg(F.count(F.lit(1)).alias("flows"))
    share = lambda c: F.round(F.try_divide(F.col(c) * 100, F.col("total")), 6)
    return counts.join(totals, "condition").select("condition", "packet_count", "flows", share("flows").alias("percent"), "outside", share("outside").alias("outside_percent"))


@query(_sql("SELECT flow_id, src_ip, dst_ip, observed_tcp_pattern, packet_count FROM lab WHERE broad_removed ORDER BY flow_id LIMIT 20"))
def removed_audit(s, d):
    return _labelled(s, d).where("broad_removed").select("flow_id", "src_ip", "dst_ip", "observed_tcp_pattern", "packet_count").orderBy("flow_id").limit(20)


@query(_sql("SELECT initial_syn_receiver_port AS port, CASE initial_syn_receiver_port WHEN 80 THEN 'http' WHEN 81 THEN 'hosts2-ns' WHEN 82 THEN 'xfer' ELSE 'unknown' END AS service, count(*) AS flows, round(median(packet_count), 6) AS median_packets, round(count(*) / (SELECT count(*) FROM q)::DOUBLE, 9) AS ratio FROM q GROUP BY 1"))
def port_services(s, d):
    rows = scan.qualifying(_flows(s, d))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    port = F.col("port")
    per = rows.groupBy(F.col("initial_syn_receiver_port").alias("port")).agg(F.count(F.lit(1)).alias("flows"), F.round(F.median("packet_count"), 6).alias("median_packets")).crossJoin(F.broadcast(total))  # one row
    return per.select("port", F.when(port == 80, "http").when(port == 81, "hosts2-ns").when(port == 82, "xfer").otherwise("unknown").alias("service"), "flows", "median_packets", F.round(F.try_divide("flows", "total"), 9).alias("ratio"))


# Comparison.


@query(_sql(", o AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY target, condition) AS points FROM ec WINDOW w AS (PARTITION BY target, condition ORDER BY packet_count)), kp AS (SELECT * FROM o WHERE points <= 4 OR place IN (SELECT unnest([(i * (points - 1)) // 3 FOR i IN [0, 1, 2, 3]]))), jp AS (SELECT *, CASE WHEN points > 4 THEN coalesce(lead(cumulative_count) OVER (PARTITION BY target, condition ORDER BY packet_count) - cumulative_count, 0) ELSE 0 END AS jump FROM kp) SELECT target, condition, packet_count, cumulative_count, total_flow_count, points AS exact_points, round(max(jump) OVER (PARTITION BY target, condition) / total_flow_count::DOUBLE, 9) AS error_bound FROM jp", ledger=True))
def ecdf_sampled(s, d):
    curves = distribution.ecdf(_cond(s, d), ["target", "condition"])
    return compare.sampled_ecdf(curves, ["target", "condition"], 4).withColumn("error_bound", F.round("error_bound", 9))


@query(_sql(", a AS (SELECT DISTINCT (" + DOT.format("net - net % 256") + ") || '/24' AS p FROM ledger WHERE selected_for_analysis), b AS (SELECT DISTINCT prefix AS p FROM ledger WHERE selected_for_analysis) SELECT count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL) AS common, count(*) FILTER (b.p IS NULL) AS a_only, count(*) FILTER (a.p IS NULL) AS b_only, round(count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL) / nullif(count(*), 0)::DOUBLE, 9) AS jaccard FROM a FULL JOIN b ON a.p = b.p", ledger=True))
def prefix_jaccard(s, d):
    return compare.set_overlap(_normalised(s, d), _selected(s, d).select(F.col("prefix").alias("p")))


def _normalised(s, d):
    return _selected(s, d).select(cidr(network(F.col("net"), F.lit(24)), F.lit(24)).alias("p")).distinct()


@query(_sql(", a AS (SELECT DISTINCT (" + DOT.format("net - net % 256") + ") || '/24' AS p FROM ledger WHERE selected_for_analysis), b AS (SELECT DISTINCT prefix AS p FROM ledger WHERE selected_for_analysis) SELECT coalesce(a.p, b.p) AS p, CASE WHEN b.p IS NULL THEN 'a_only' WHEN a.p IS NULL THEN 'b_only' ELSE 'common' END AS presence FROM a FULL JOIN b ON a.p = b.p", ledger=True))
def prefix_presence(s, d):
    return compare.presence(_normalised(s, d), _selected(s, d).select(F.col("prefix").alias("p")))


_UNIONS = ", nu AS (SELECT DISTINCT flow_id FROM mem), wu AS (SELECT DISTINCT flow_id FROM mem24)"


@query(_sql(_UNIONS + " SELECT coalesce(n.flow_id, w.flow_id) IS NOT NULL AND w.flow_id IS NOT NULL AS wide, n.flow_id IS NOT NULL AS native, count(*) AS flows, sum(packet_count)::BIGINT AS packets FROM nu n FULL JOIN wu w USING (flow_id) JOIN lab ON lab.flow_id = coalesce(n.flow_id, w.flow_id) GROUP BY 1, 2", ledger=True))
def scope_components(s, d):
    """Flows of the native and the /24 union: common, native only (none), wide only."""
    native = _members(s, d).select("flow_id").distinct().withColumn("native", F.lit(True))
    wide = _members(s, d, "normalized_24").select("flow_id").distinct().withColumn("wide", F.lit(True))
    both = native.join(wide, "flow_id", "full_outer").fillna(False)
    return both.join(_labelled(s, d), "flow_id").groupBy("wide", "native").agg(F.count(F.lit(1)).alias("flows"), F.sum("packet_count").alias("packets"))


def _ks_sql(one: str, other: str) -> str:
    return f", pa AS ({one}), pb AS ({other}), x AS (SELECT packet_count, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM (SELECT packet_count, 'a' AS side FROM pa UNION ALL SELECT packet_count, 'b' FROM pb) GROUP BY 1), y AS (SELECT sum(na) OVER (ORDER BY packet_count) AS ca, sum(nb) OVER (ORDER BY packet_count) AS cb, sum(na) OVER () AS ta, sum(nb) OVER () AS tb FROM x) SELECT round(max(abs(ca / ta::DOUBLE - cb / tb::DOUBLE)), 9) AS ks FROM y"


def _ks(s, one, other):
    rows = one.select("packet_count", F.lit("a").alias("side")).unionByName(other.select("packet_count", F.lit("b").alias("side")))
    freq = rows.groupBy("packet_count").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))  # a row a flow length
    run = Window.partitionBy(F.lit(1)).orderBy("packet_count").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(F.lit(1))
    gap = F.abs(F.try_divide(F.sum("na").over(run), F.sum("na").over(total)) - F.try_divide(F.sum("nb").over(run), F.sum("nb").over(total)))
    return freq.select(gap.alias("gap")).agg(F.round(F.max("gap"), 9).alias("ks"))


@query(_sql(_UNIONS + _ks_sql("SELECT packet_count FROM lab JOIN nu USING (flow_id)", "SELECT packet_count FROM lab JOIN wu USING (flow_id)"), ledger=True))
def scope_ks(s, d):
    pick = lambda scope: _labelled(s, d).join(_members(s, d, scope).select("flow_id").distinct(), "flow_id", "left_semi")
    return _ks(s, pick("native"), pick("normalized_24"))


_FIRST = "(SELECT min(analysis_prefix) FROM mem)"


@query(_sql(f", bf AS (SELECT count(DISTINCT flow_id) AS before FROM mem), af AS (SELECT count(DISTINCT flow_id) AS after FROM mem WHERE analysis_prefix <> {_FIRST}) SELECT {_FIRST} AS excluded, before, after, before - after AS removed FROM bf, af", ledger=True))
def without_prefix(s, d):
    """The union of selected prefixes before and after one is left out; shared flows survive."""
    mem = _members(s, d)
    first = mem.agg(F.min("analysis_prefix")).first()[0]  # one row
    before = mem.agg(F.countDistinct("flow_id").alias("before"))
    after = compare.without(mem, first).agg(F.count(F.lit(1)).alias("after"))
    return before.crossJoin(F.broadcast(after)).select(F.lit(first).alias("excluded"), "before", "after", (F.col("before") - F.col("after")).alias("removed"))  # one row each


@query(_sql("SELECT target, sum(n) FILTER (condition = 'raw')::BIGINT AS raw, sum(n) FILTER (condition = 'retained')::BIGINT AS retained FROM cond GROUP BY 1", ledger=True))
def condition_pivot(s, d):
    return _cond(s, d).groupBy("target").pivot("condition", ["raw", "retained"]).agg(F.sum("n"))


@query(_sql("SELECT prefix, prefix_length, total_count FROM ledger WHERE contains(prefix, '.168.') ORDER BY total_count DESC, prefix LIMIT 25", ledger=True))
def ledger_search(s, d):
    """A dashboard's table: substring filter, counts from the greatest, nulls last, names in order."""
    from .catalog import _candidates, prefixes

    return prefixes.ledger(_candidates(s, d)).where(F.contains("prefix", F.lit(".168."))).orderBy(F.desc_nulls_last("total_count"), "prefix").limit(25).select("prefix", "prefix_length", "total_count")


# One-packet context.

_COHORT = "co AS (SELECT * FROM lab WHERE packet_count = 1 AND NOT broad_removed)"


def _targets(s, d):
    return context.cohort(build_labelled_timeout(s, d))


@query(_sql(f", {_COHORT}, m AS (SELECT c.flow_id, count(k.packet_index) AS matches FROM co c LEFT JOIN k ON k.ts = c.start_time AND k.protocol = c.protocol AND ((k.src_ip = c.src_ip AND k.src_port = c.src_port AND k.dst_ip = c.dst_ip AND k.dst_port = c.dst_port) OR (k.src_ip = c.dst_ip AND k.src_port = c.dst_port AND k.dst_ip = c.src_ip AND k.dst_port = c.src_port)) GROUP BY 1) SELECT matches, count(*) AS targets FROM m GROUP BY 1", "259200"))
def target_matches(s, d):
    return context.target_matches(_targets(s, d), packets(s, d)).groupBy("matches").agg(F.count(F.lit(1)).alias("targets"))


@query(_sql(f", {_COHORT}, ks AS (SELECT DISTINCT least(src_ip || ' ' || src_port, dst_ip || ' ' || dst_port) AS a, greatest(src_ip || ' ' || src_port, dst_ip || ' ' || dst_port) AS b, protocol FROM co), en AS (SELECT src_ip AS ip FROM co UNION SELECT dst_ip FROM co) SELECT (SELECT count(*) FROM k SEMI JOIN ks ON ks.protocol = k.protocol AND ks.a = least(k.src_ip || ' ' || k.src_port, k.dst_ip || ' ' || k.dst_port) AND ks.b = greatest(k.src_ip || ' ' || k.src_port, k.dst_ip || ' ' || k.dst_port)) AS tuple_packets, (SELECT count(*) FROM k WHERE protocol = 6 AND fl & 2 <> 0 AND fl & 16 = 0 AND src_ip IN (SELECT ip FROM en)) AS source_syns", "259200"))
def context_observations(s, d):
    found, syns = context.observations(_targets(s, d), packets(s, d))
    return found.agg(F.count(F.lit(1)).alias("tuple_packets")).crossJoin(F.broadcast(syns.agg(F.count(F.lit(1)).alias("source_syns"))))  # one row each


_W = " LEFT JOIN ".join(["co", *[f"(SELECT l.flow_id, count(*) AS packets_{n}, count(DISTINCT k.dst_ip || ':' || k.dst_port) AS unique_targets_{n}, count(DISTINCT k.dst_ip) AS unique_ips_{n}, count(DISTINCT k.dst_port) AS unique_ports_{n} FROM co l JOIN k ON k.src_ip = l.src_ip AND k.protocol = 6 AND k.fl & 2 <> 0 AND k.fl & 16 = 0 AND abs(k.ts - l.start_time) <= {w} WHERE l.initial_syn_sender_ip IS NOT NULL GROUP BY 1) w{n} USING (flow_id)" for n, w in context.WINDOWS.items()]])


@query(_sql(f", {_COHORT} SELECT flow_id, initial_syn_sender_ip IS NOT NULL AS applicable, " + ", ".join(f"{c}_{n}" for n in context.WINDOWS for c in ("packets", "unique_targets", "unique_ips", "unique_ports")) + f" FROM {_W}", "259200"))
def source_windows(s, d):
    syns = packets(s, d).where("protocol = 6 and (flags & 2) != 0 and (flags & 16) = 0")
    return context.source_contexts(_targets(s, d), syns)


@query(_sql("SELECT CASE WHEN protocol = 17 THEN NULL ELSE (CASE WHEN fl & 2 <> 0 THEN 'S' ELSE '' END) || (CASE WHEN fl & 4 <> 0 THEN 'R' ELSE '' END) || (CASE WHEN fl & 8 <> 0 THEN 'P' ELSE '' END) || (CASE WHEN fl & 16 <> 0 THEN 'A' ELSE '' END) END AS flags_text, count(*) AS packets FROM k GROUP BY 1"))
def flag_texts(s, d):
    return packets(s, d).groupBy(context.flag_text(F.col("flags")).alias("flags_text")).agg(F.count(F.lit(1)).alias("packets"))


# Time slots.


@query("SELECT strftime(s, '%Y%m%d%H%M') AS chunk_id, epoch(s)::BIGINT AS start_s FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01 23:45:00', INTERVAL 15 MINUTE)) AS s)")
def chunk_plan(s, d):
    """The 96 quarter hours of a day."""
    slots = s.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(95))).alias("i")).select((F.lit(1704067200) + F.col("i") * 900).cast("long").alias("start_s"))
    return slots.select(F.date_format(F.expr("timestampadd(SECOND, start_s, timestamp_ntz'1970-01-01 00:00:00')"), "yyyyMMddHHmm").alias("chunk_id"), "start_s")


@query(_sql(", c AS (SELECT floor(ts / 86400)::BIGINT AS slot, count(*) AS n FROM k GROUP BY 1), r AS (SELECT sum(n) OVER (ORDER BY slot ROWS 2 PRECEDING) AS load FROM c) SELECT max(load)::BIGINT AS most FROM r"))
def rolling_load(s, d):
    """The most packets in any three slots in a row, of what is one row a slot."""
    slots = packets(s, d).groupBy(F.floor(F.col("ts") / DAY).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(F.lit(1)).orderBy("slot").rowsBetween(-2, 0)
    return slots.select(F.sum("n").over(run).alias("load")).agg(F.max("load").alias("most"))


# Captures.

BLOCK = 4096


@query(_sql(f"SELECT (packet_index // {BLOCK})::VARCHAR AS file, row_number() OVER (PARTITION BY packet_index // {BLOCK} ORDER BY packet_index) AS packet_index, round(ts * 1000000)::BIGINT AS ts_us, 'ok' AS status, 4 AS ip_version, protocol, src_ip, src_port, dst_ip, dst_port, CASE WHEN protocol = 6 THEN fl END AS flags, frame - CASE WHEN protocol = 6 THEN 54 ELSE 42 END AS payload_bytes, frame AS frame_bytes, frame - 14 AS ip_bytes FROM k"))
def capture_packets(s, d):
    """The packets written as nanosecond captures, and read back from their bytes.  User ids over 25,535 give ports and
    those over 63,999 address parts that no Ethernet capture holds; captures with such ids are of WIDE records."""
    files = capture.to_captures(packets(s, d).select("packet_index", "ts", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "flags", "frame_bytes"), BLOCK, wide=True)
    return capture.decode_captures(files).select("file", "packet_index", F.round(F.col("ts") * 1000000).cast("long").alias("ts_us"), "status", "ip_version", "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "flags", "payload_bytes", "frame_bytes", "ip_bytes")


@query(_sql(f"SELECT (packet_index // {BLOCK})::VARCHAR AS file, round(arg_min(ts, packet_index) * 1000000)::BIGINT AS start_us FROM k GROUP BY 1"))
def capture_starts(s, d):
    files = capture.to_captures(packets(s, d).select("packet_index", "ts", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "flags", "frame_bytes"), BLOCK, wide=True)
    return capture.capture_start(capture.decode_captures(files)).select("file", F.round(F.col("capture_start") * 1000000).cast("long").alias("start_us"))


@query(_sql("SELECT flow_id, src_ip, src_port, dst_ip, dst_port, protocol, packet_count, byte_count, floor(start_time)::BIGINT AS start_s, floor(end_time)::BIGINT AS end_s FROM fl"))
def flow_records(s, d):
    """Flows as 56-byte records, read back from their bytes; the flows of user ids over 25,535 as WIDE ones."""
    return wire.from_records(wire.to_records(wire.checked_flows(_flows(s, d), wide=True), wide=True))


@query(_sql("SELECT count(*) AS input_rows, 0::BIGINT AS excluded_ipv6, 0::BIGINT AS excluded_protocol, count(*) AS included_flows, sum(packet_count)::BIGINT AS included_packets, sum(byte_count)::BIGINT AS included_bytes FROM fl"))
def record_audit(s, d):
    return wire.conversion_audit(_flows(s, d))


# Heavy hitters.

_levels, _rest = f", w0 AS (SELECT {IP.format('src_ip')} AS ip, sum(byte_count) AS w FROM fl GROUP BY 1), tt AS (SELECT (sum(w) * 2 + 99) // 100 AS least FROM w0)", "SELECT ip AS net, w FROM w0"
for _n in range(32, 0, -1):
    _levels += f", h{_n} AS (SELECT net - net % (1::BIGINT << {32 - _n}) AS net, sum(w)::BIGINT AS w FROM ({_rest}) GROUP BY 1)"
    _rest = f"SELECT net, w FROM h{_n} WHERE w < (SELECT least FROM tt)"
_LEVELS_SQL = _levels + ", found AS (" + " UNION ALL ".join(f"SELECT net, {n} AS len, w FROM h{n} WHERE w >= (SELECT least FROM tt)" for n in range(32, 0, -1)) + f" UNION ALL SELECT 0, 0, coalesce(sum(w), 0)::BIGINT FROM ({_rest}))"


def _weights(s, d):
    return _flows(s, d).groupBy(F.col("src_n").alias("ip4")).agg(F.sum("byte_count").alias("w"))


def _found(s, d):
    return stored(s, d, "heavy", lambda: heavy.residuals(_weights(s, d), 2, lambda df, name: stored(s, d, name, lambda: df)))


@query(_sql(_LEVELS_SQL + " SELECT (" + DOT.format("net") + ") || '/' || len AS prefix, w AS residual FROM found"))
def heavy_residuals(s, d):
    """Residual heavy hitters of source addresses by bytes at 2 percent, at every prefix length."""
    return _found(s, d).select("prefix", "residual")


@query(_sql(_LEVELS_SQL + " SELECT (SELECT sum(w) FROM found)::BIGINT AS residuals, (SELECT sum(w) FROM w0)::BIGINT AS weights, (SELECT sum(w) FROM found) = (SELECT sum(w) FROM w0) AS conserved"))
def heavy_conserved(s, d):
    return heavy.conserved(_found(s, d), _weights(s, d))


@query(_sql(_LEVELS_SQL + ", fp AS (SELECT " + IP.format("src_ip") + " AS ip, protocol, sum(byte_count) AS w FROM fl GROUP BY 1, 2), ow AS (SELECT fp.ip, fp.protocol, any_value(fp.w) AS w, arg_max(found.net, found.len) AS net, max(found.len) AS len FROM fp JOIN found ON fp.ip - fp.ip % (1::BIGINT << (32 - found.len)) = found.net GROUP BY 1, 2) SELECT (" + DOT.format("ow.net") + ") || '/' || ow.len AS prefix, ow.protocol, sum(ow.w)::BIGINT AS w FROM ow JOIN found ON found.net = ow.net AND found.len = ow.len GROUP BY ow.net, ow.len, ow.protocol HAVING sum(ow.w) * 100 >= any_value(found.w) * 8"))
def heavy_protocols(s, d):
    """Protocols of each residual at four times the address percentage."""
    rows = _flows(s, d).groupBy(F.col("src_n").alias("ip4"), "protocol").agg(F.sum("byte_count").alias("w"))
    return heavy.protocols(rows, _found(s, d), 2)


@query(None)
def heavy_two_stage(s, d):
    """The search on two input blocks and again on their residuals."""
    rows = _flows(s, d).groupBy((F.col("flow_id") % 2).alias("block"), F.col("src_n").alias("ip4")).agg(F.sum("byte_count").alias("w"))
    return heavy.two_stage(rows, 2, lambda df, name: stored(s, d, f"two-{name}", lambda: df)).select("prefix", "residual")
