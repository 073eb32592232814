"""Registered queries of the flow-analytics operators and their SQL oracles.

Each entry is a pair (query, DuckDB SQL).  All run on the whole surrogate packet table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ip import cidr, network
from ..operators import context, distribution, prefixes, scan
from ..operators.flows import build_flows
from ..sources.store import stored
from .surrogate import flows_sql, packets

TIMEOUT = 3 * 86400.0
SIZE, STEP, ANCHOR = 3 * 86400.0, 86400.0, 1704067200.0


def _flows(s, d):
    # Built once an application; every other query reads it.
    return stored(s, d, "flows", lambda: build_flows(packets(s, d)))


def _windows(s, d):
    return scan.scan_windows(_flows(s, d), SIZE, STEP, ANCHOR)


def _strict(s, d):
    return scan.strict_windows(_windows(s, d), 2, 2)


def _labelled(s, d):
    return stored(s, d, "labelled", lambda: scan.label_flows(_flows(s, d), scan.scan_sources(_strict(s, d))))


def _candidates(s, d):
    f = _flows(s, d)
    side = lambda ip, n: cidr(network(F.col(ip), n), n)
    return f.select(side("src_n", 23 + F.col("src_port") % 4).alias("src_prefix"), side("dst_n", 24 + F.col("dst_port") % 3).alias("dst_prefix"))


def _selected(s, d):
    return stored(s, d, "selected", lambda: prefixes.ledger(_candidates(s, d)).where("selected_for_analysis").select("net", "prefix_length", "prefix"))


def _members(s, d, scope="native"):
    return stored(s, d, f"members-{scope}", lambda: prefixes.membership(_flows(s, d), _selected(s, d), scope))


def _cond(s, d):
    return stored(s, d, "conditions", lambda: distribution.conditions(distribution.frequencies(_labelled(s, d), _members(s, d))))


BASE = ["flow_id", "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "start_time", "end_time", "duration", "packet_count", "byte_count", "transport_payload_byte_count", "packets_from_src", "packets_from_dst", "bytes_from_src", "bytes_from_dst"]
DIRECTIONAL = ["flow_id", "initial_syn_sender_ip", "initial_syn_sender_port", "initial_syn_receiver_ip", "initial_syn_receiver_port", "first_syn_time", "first_responder_synack_time", "first_responder_rst_time", "first_initiator_rst_time", "syn_from_initiator", "syn_from_responder", "synack_from_initiator", "synack_from_responder", "rst_from_initiator", "rst_from_responder", "ack_after_synack_observed", "non_syn_response_observed", "transport_payload_observed"]
IP = "(split_part({0}, '.', 1)::BIGINT * 16777216 + split_part({0}, '.', 2)::BIGINT * 65536 + split_part({0}, '.', 3)::BIGINT * 256 + split_part({0}, '.', 4)::BIGINT)"
DOT = "((({0}) >> 24) & 255) || '.' || ((({0}) >> 16) & 255) || '.' || ((({0}) >> 8) & 255) || '.' || (({0}) & 255)"
LEDGER = f""",
cand AS (SELECT {IP.format("src_ip")} AS ip, 23 + src_port % 4 AS len, 1 AS s FROM fl UNION ALL SELECT {IP.format("dst_ip")}, 24 + dst_port % 3, 0 FROM fl),
led AS (SELECT ip - ip % (1::BIGINT << (32 - len)) AS net, len, sum(s)::BIGINT AS src_count, (count(*) - sum(s))::BIGINT AS dst_count, count(*) AS total_count FROM cand GROUP BY 1, 2),
led2 AS (SELECT a.*, (SELECT min(b.len) FROM led b WHERE b.len >= 24 AND b.len < a.len AND a.len >= 24 AND b.net = a.net - a.net % (1::BIGINT << (32 - b.len))) AS top FROM led a),
ledger AS (SELECT ({DOT.format("net")}) || '/' || len AS prefix, len::INT AS prefix_length, net, CASE WHEN len >= 24 THEN ({DOT.format("net - net % 256")}) || '/24' END AS normalized_prefix_24, src_count > 0 AS seen_as_src_prefix, dst_count > 0 AS seen_as_dst_prefix, src_count, dst_count, total_count,
  len >= 24 AND top IS NULL AS selected_for_analysis, CASE WHEN len < 24 THEN 'broader_than_24' WHEN top IS NOT NULL THEN 'covered_by_parent' END AS exclusion_reason, CASE WHEN top IS NOT NULL THEN ({DOT.format("net - net % (1::BIGINT << (32 - top))")}) || '/' || top END AS covered_by_prefix FROM led2),
sel AS (SELECT prefix, net AS lo, net + (1::BIGINT << (32 - prefix_length)) - 1 AS hi FROM ledger WHERE selected_for_analysis),
fi AS (SELECT *, {IP.format("src_ip")} AS si, {IP.format("dst_ip")} AS di FROM lab),
mem AS (SELECT flow_id, prefix AS analysis_prefix, si BETWEEN lo AND hi AS src_match, di BETWEEN lo AND hi AS dst_match, 'native' AS analysis_scope FROM fi JOIN sel ON si BETWEEN lo AND hi OR di BETWEEN lo AND hi),
s24 AS (SELECT DISTINCT lo - lo % 256 AS lo FROM sel),
mem24 AS (SELECT flow_id, ({DOT.format("lo")}) || '/24' AS analysis_prefix, si - si % 256 = lo AS src_match, di - di % 256 = lo AS dst_match, 'normalized_24' AS analysis_scope FROM fi JOIN s24 ON si - si % 256 = lo OR di - di % 256 = lo),
freq AS (SELECT target, packet_count, broad_removed, count(*) AS n FROM (SELECT analysis_prefix AS target, packet_count, broad_removed FROM mem JOIN lab USING (flow_id) UNION ALL SELECT 'selected_union', packet_count, broad_removed FROM lab WHERE flow_id IN (SELECT flow_id FROM mem) UNION ALL SELECT 'overall_ipv4', packet_count, broad_removed FROM lab) GROUP BY 1, 2, 3),
cond AS (SELECT target, 'raw' AS condition, packet_count, sum(n)::BIGINT AS n FROM freq GROUP BY 1, 3 UNION ALL SELECT target, CASE WHEN broad_removed THEN 'removed' ELSE 'retained' END, packet_count, n FROM freq),
ec AS (SELECT target, condition, packet_count, n AS frequency, sum(n) OVER (PARTITION BY target, condition ORDER BY packet_count)::BIGINT AS cumulative_count, sum(n) OVER (PARTITION BY target, condition)::BIGINT AS total_flow_count FROM cond)"""


def _sql(body: str, timeout: str = "NULL", ledger: bool = False) -> str:
    return f"WITH {flows_sql(timeout)}{LEDGER if ledger else ''} {body}"


def _removal(s, d):
    lab, mem = _labelled(s, d), _members(s, d)
    rows = lab.join(mem.select("flow_id", "analysis_prefix"), "flow_id")
    return rows.groupBy("analysis_prefix").agg(F.count(F.lit(1)).alias("raw_flows"), F.count_if("strict_removed").alias("strict_removed_flows"), F.count_if("broad_removed").alias("broad_removed_flows")).withColumn("broad_rate", F.round(F.try_divide("broad_removed_flows", F.col("raw_flows")), 9))


def _hosts(s, d):
    mem = _members(s, d).join(_labelled(s, d).select("flow_id", "src_ip", "dst_ip", "packets_from_src", "packets_from_dst", "broad_removed"), "flow_id")
    sides = F.explode(F.array(F.struct(F.col("src_match").alias("inside"), F.col("src_ip").alias("ip"), (F.col("packets_from_src") > 0).alias("sent")), F.struct(F.col("dst_match").alias("inside"), F.col("dst_ip").alias("ip"), (F.col("packets_from_dst") > 0).alias("sent"))))
    ends = mem.select("analysis_prefix", "broad_removed", sides.alias("e")).where("e.inside").groupBy("analysis_prefix", "e.ip", "broad_removed").agg(F.bool_or("e.sent").alias("sent"))
    per = ends.groupBy("analysis_prefix", "ip").agg(F.bool_or("sent").alias("raw"), F.bool_or("broad_removed").alias("in_removed"), F.bool_or(~F.col("broad_removed")).alias("in_retained"), F.bool_or(F.col("sent") & F.col("broad_removed")).alias("sent_removed"))
    return per.groupBy("analysis_prefix").agg(F.count(F.lit(1)).alias("raw_endpoints"), F.count_if("raw").alias("raw_senders"), F.count_if("in_removed").alias("removed_endpoints"), F.count_if("in_retained").alias("retained_endpoints"), F.count_if("sent_removed").alias("removed_senders"))


def _condition(s, d):
    lab = _labelled(s, d).withColumn("condition", F.explode(F.array_compact(F.array(F.lit("raw"), F.when(~F.col("strict_removed"), "strict"), F.when(~F.col("broad_removed"), "broad")))))
    return lab.groupBy("condition").agg(F.count(F.lit(1)).alias("flows"), F.sum("packet_count").alias("packets"), F.sum("byte_count").alias("bytes"), F.round(F.median("packet_count"), 6).alias("median_packets"), F.round(F.median("byte_count"), 6).alias("median_bytes"), F.round(F.median("duration"), 4).alias("median_duration"))


def _legacy(s, d):
    rows = _flows(s, d).join(_members(s, d).where("dst_match").select("flow_id", "analysis_prefix"), "flow_id")
    feats = rows.groupBy("analysis_prefix").agg(F.count(F.lit(1)).alias("flow_count"), F.sum("packet_count").alias("packet_count"), F.sum("byte_count").alias("byte_count"), F.avg((F.col("duration") <= 1.0).cast("double")).alias("short_ratio"), F.avg((F.col("packet_count") <= 3).cast("double")).alias("tiny_ratio"), F.avg((F.col("rst_count") > 0).cast("double")).alias("rst_ratio"))
    return prefixes.legacy_score(feats, {"flow_count": 0.2, "packet_count": 0.2, "byte_count": 0.2, "short_ratio": 0.15, "tiny_ratio": 0.15, "rst_ratio": 0.1}).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), F.desc("flow_count"), F.desc("packet_count"), F.desc("byte_count"), "analysis_prefix").limit(10).select("analysis_prefix", "flow_count", "packet_count", "byte_count", "score")


def _dominant(s, d):
    per = scan.qualifying(_flows(s, d)).groupBy("initial_syn_sender_ip", "observed_tcp_pattern").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("initial_syn_sender_ip").agg(F.max("n").alias("n"), F.max_by("observed_tcp_pattern", "n").alias("p"), F.collect_list("n").alias("all"))  # four patterns at most
    return top.select("initial_syn_sender_ip", "n", F.when(F.size(F.filter("all", lambda x: x == F.col("n"))) > 1, "tie").otherwise(F.col("p")).alias("dominant_pattern"))


def _diversity(s, d):
    return scan.qualifying(_flows(s, d)).groupBy("initial_syn_sender_ip").agg(F.countDistinct("initial_syn_receiver_ip").alias("ips"), F.countDistinct("initial_syn_receiver_port").alias("ports"), F.countDistinct(F.struct("initial_syn_receiver_ip", "initial_syn_receiver_port")).alias("targets"))


def _exclusive(s, d):
    mem = _members(s, d)
    degree = mem.groupBy("flow_id").agg(F.count(F.lit(1)).alias("degree"))
    return mem.join(degree, "flow_id").groupBy("analysis_prefix").agg(F.count(F.lit(1)).alias("flows"), F.count_if(F.col("degree") == 1).alias("exclusive_flows"))


def _audit(s, d):
    per = _members(s, d).groupBy("flow_id").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.sum("k").alias("rows"), F.count(F.lit(1)).alias("unique_flows"), (F.sum("k") - F.count(F.lit(1))).alias("extra_memberships"), F.count_if(F.col("k") > 1).alias("multi_prefix_flows"))


def _jaccard(s, d):
    lab = _labelled(s, d)
    sets = lab.select("flow_id", F.explode(F.array_compact(F.array(F.lit("raw"), F.when(~F.col("strict_removed"), "strict"), F.when(~F.col("broad_removed"), "broad")))).alias("name"))
    return distribution.jaccard(sets, "flow_id", ["raw", "strict", "broad"]).withColumn("jaccard", F.round("jaccard", 9))


def _tuple(s, d):
    t = context.cohort(build_labelled_timeout(s, d))
    return context.tuple_context(t, packets(s, d), (3600, 86400, 259200))


def build_labelled_timeout(s, d):
    def build():
        f = build_flows(packets(s, d), TIMEOUT)
        return scan.label_flows(f, scan.scan_sources(scan.strict_windows(scan.scan_windows(f, SIZE, STEP, ANCHOR), 2, 2)))

    return stored(s, d, "labelled-timeout", build)


def _source(s, d):
    t = context.cohort(build_labelled_timeout(s, d)).where("initial_syn_sender_ip is not null")
    p = packets(s, d).where("protocol = 6 and (flags & 2) != 0 and (flags & 16) = 0")
    return context.source_context(t, p, 86400.0)


def _coverage(s, d):
    lab = _labelled(s, d)
    hit = lab.join(_members(s, d).select("flow_id").distinct(), "flow_id", "left_semi").agg(F.count(F.lit(1)).alias("f"), F.sum("packet_count").alias("p"), F.sum("byte_count").alias("b"))
    return lab.agg(F.count(F.lit(1)).alias("tf"), F.sum("packet_count").alias("tp"), F.sum("byte_count").alias("tb")).crossJoin(F.broadcast(hit)).select(*[F.round(F.try_divide(F.col(a), F.col("t" + a)), 9).alias(n) for a, n in (("f", "flow_coverage"), ("p", "packet_coverage"), ("b", "byte_coverage"))])


def _heavy(s, d):
    w = _flows(s, d).groupBy(F.col("src_n").alias("ip4")).agg(F.sum("byte_count").alias("w"))
    return prefixes.heavy_prefixes(w, 2)


_LEVELS = ""
_rest = "SELECT ip AS net, w FROM w0"
for _n in (32, 24, 16, 8):
    _LEVELS += f", l{_n} AS (SELECT net - net % (1::BIGINT << {32 - _n}) AS net, sum(w)::BIGINT AS w FROM ({_rest}) GROUP BY 1)"
    _rest = f"SELECT net, w FROM l{_n} WHERE w * 100 < (SELECT sum(w) FROM w0) * 2"
HEAVY = f", w0 AS (SELECT {IP.format('src_ip')} AS ip, sum(byte_count) AS w FROM fl GROUP BY 1){_LEVELS} SELECT '0.0.0.0/0' AS prefix, coalesce(sum(w), 0)::BIGINT AS residual FROM ({_rest})" + "".join(f" UNION ALL SELECT ({DOT.format('net')}) || '/{_n}', w FROM l{_n} WHERE w * 100 >= (SELECT sum(w) FROM w0) * 2" for _n in (32, 24, 16, 8))
LEGACY = """, lf AS (SELECT analysis_prefix, count(*) AS flow_count, sum(packet_count)::BIGINT AS packet_count, sum(byte_count)::BIGINT AS byte_count, avg((duration <= 1.0)::INT) AS sr, avg((packet_count <= 3)::INT) AS tr, avg((rst_count > 0)::INT) AS rr FROM lab JOIN mem USING (flow_id) WHERE dst_match GROUP BY 1),
 lr AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY flow_count) + (count(*) OVER (PARTITION BY flow_count) - 1) / 2.0 AS a, rank() OVER (ORDER BY packet_count) + (count(*) OVER (PARTITION BY packet_count) - 1) / 2.0 AS b, rank() OVER (ORDER BY byte_count) + (count(*) OVER (PARTITION BY byte_count) - 1) / 2.0 AS c FROM lf)
 SELECT analysis_prefix, flow_count, packet_count, byte_count, round(.2 * a / n + .2 * b / n + .2 * c / n + .15 * (1 - sr) + .15 * (1 - tr) + .1 * (1 - rr), 9)::DOUBLE AS score FROM lr ORDER BY score DESC, flow_count DESC, packet_count DESC, byte_count DESC, analysis_prefix LIMIT 10"""
HIST = """, e AS (SELECT lo, CASE WHEN lo < 3 THEN lo + 1 WHEN lo = 3 THEN 4 ELSE 2 * lo END AS hi FROM (SELECT unnest([1, 2, 3] || [1::BIGINT << k FOR k IN range(2, 62)])::BIGINT AS lo) WHERE lo <= greatest(4, (SELECT max(packet_count) FROM cond)))
 SELECT t.target, t.condition, e.lo, e.hi, coalesce(sum(c.n), 0)::BIGINT AS n FROM (SELECT DISTINCT target, condition FROM cond) t CROSS JOIN e LEFT JOIN cond c ON c.target = t.target AND c.condition = t.condition AND c.packet_count >= e.lo AND c.packet_count < e.hi GROUP BY 1, 2, 3, 4"""
KS = ", x AS (SELECT target, packet_count, sum(CASE WHEN condition = 'raw' THEN n ELSE 0 END) AS na, sum(CASE WHEN condition = 'retained' THEN n ELSE 0 END) AS nb FROM cond WHERE condition <> 'removed' GROUP BY 1, 2), y AS (SELECT target, sum(na) OVER r AS ca, sum(nb) OVER r AS cb, sum(na) OVER (PARTITION BY target) AS ta, sum(nb) OVER (PARTITION BY target) AS tb FROM x WINDOW r AS (PARTITION BY target ORDER BY packet_count)) SELECT target, CASE WHEN max(ta) * max(tb) > 0 THEN max(abs(ca * tb - cb * ta))::DOUBLE / (max(ta)::DOUBLE * max(tb)::DOUBLE) END AS ks FROM y GROUP BY 1"
TUPLE = "SELECT l.flow_id, l.start_time AS t0, count(*) AS total, count(*) FILTER (k.ts < start_time) AS before, count(*) FILTER (k.ts > start_time) AS after, count(*) FILTER (k.src_ip = l.src_ip AND k.src_port = l.src_port) AS forward, count(*) FILTER (NOT (k.src_ip = l.src_ip AND k.src_port = l.src_port)) AS reverse, max(k.ts) FILTER (k.ts < start_time) AS previous_ts, min(k.ts) FILTER (k.ts > start_time) AS next_ts, max(k.ts) FILTER (k.ts < start_time AND k.src_ip <> l.src_ip) AS reverse_before_ts, min(k.ts) FILTER (k.ts > start_time AND k.src_ip <> l.src_ip) AS reverse_after_ts" + "".join(f", count(*) FILTER (k.ts < start_time AND k.ts - start_time >= -{n}) AS before_{n}s, count(*) FILTER (k.ts > start_time AND k.ts - start_time <= {n}) AS after_{n}s" for n in (3600, 86400, 259200)) + " FROM lab l JOIN k ON k.protocol = l.protocol AND ((k.src_ip = l.src_ip AND k.src_port = l.src_port AND k.dst_ip = l.dst_ip AND k.dst_port = l.dst_port) OR (k.src_ip = l.dst_ip AND k.src_port = l.dst_port AND k.dst_ip = l.src_ip AND k.dst_port = l.src_port)) WHERE l.packet_count = 1 AND NOT broad_removed GROUP BY 1, 2"
SOURCE = "SELECT l.flow_id, count(*) AS packets, count(DISTINCT k.dst_ip || ':' || k.dst_port) AS unique_targets, count(DISTINCT k.dst_ip) AS unique_ips, count(DISTINCT k.dst_port) AS unique_ports FROM lab l JOIN k ON k.src_ip = l.src_ip AND k.protocol = 6 AND k.fl & 2 <> 0 AND k.fl & 16 = 0 AND abs(k.ts - l.start_time) <= 86400 WHERE l.packet_count = 1 AND NOT broad_removed AND l.initial_syn_sender_ip IS NOT NULL GROUP BY 1"
_c3 = "(SELECT *, unnest([x FOR x IN ['raw', CASE WHEN NOT strict_removed THEN 'strict' END, CASE WHEN NOT broad_removed THEN 'broad' END] IF x IS NOT NULL]) AS name FROM lab)"
JACCARD = f", v AS (SELECT flow_id, name FROM {_c3}) SELECT x.a, x.b, count(*) FILTER (ha AND hb) AS common, count(*) FILTER (ha OR hb) AS either, round(count(*) FILTER (ha AND hb) / nullif(count(*) FILTER (ha OR hb), 0)::DOUBLE, 9) AS jaccard FROM (VALUES ('raw', 'strict'), ('raw', 'broad'), ('strict', 'broad')) x(a, b) CROSS JOIN LATERAL (SELECT flow_id, bool_or(name = x.a) AS ha, bool_or(name = x.b) AS hb FROM v GROUP BY 1) GROUP BY 1, 2"
HOSTS = ", ends AS (SELECT analysis_prefix, broad_removed, src_ip AS ip, packets_from_src > 0 AS sent FROM mem JOIN lab USING (flow_id) WHERE src_match UNION ALL SELECT analysis_prefix, broad_removed, dst_ip, packets_from_dst > 0 FROM mem JOIN lab USING (flow_id) WHERE dst_match) SELECT analysis_prefix, count(DISTINCT ip) AS raw_endpoints, count(DISTINCT CASE WHEN sent THEN ip END) AS raw_senders, count(DISTINCT CASE WHEN broad_removed THEN ip END) AS removed_endpoints, count(DISTINCT CASE WHEN NOT broad_removed THEN ip END) AS retained_endpoints, count(DISTINCT CASE WHEN broad_removed AND sent THEN ip END) AS removed_senders FROM ends GROUP BY 1"

CATALOG = {
    "flow_patterns": (lambda s, d: _flows(s, d).groupBy("protocol", "observed_tcp_pattern").agg(F.count(F.lit(1)).alias("flows"), F.sum("packet_count").alias("packets")), _sql("SELECT protocol, observed_tcp_pattern, count(*) AS flows, sum(packet_count)::BIGINT AS packets FROM fl GROUP BY 1, 2")),
    "flows_basic": (lambda s, d: _flows(s, d).select(*BASE), _sql(f"SELECT {', '.join(BASE)} FROM fl")),
    "flows_directional": (lambda s, d: _flows(s, d).select(*DIRECTIONAL), _sql(f"SELECT {', '.join(DIRECTIONAL)} FROM fl")),
    "flows_timeout": (lambda s, d: build_flows(packets(s, d), TIMEOUT).select(*BASE, "observed_tcp_pattern"), _sql(f"SELECT {', '.join(BASE)}, observed_tcp_pattern FROM fl", "259200")),
    "flow_flag_totals": (lambda s, d: _flows(s, d).select("flow_id", "syn_count", "syn_ack_count", "ack_count", "rst_count"), _sql("SELECT flow_id, syn_count, syn_ack_count, ack_count, rst_count FROM fl")),
    "protocol_mix": (lambda s, d: _flows(s, d).groupBy("protocol").agg(F.count(F.lit(1)).alias("flows"), F.sum("byte_count").alias("bytes")), _sql("SELECT protocol, count(*) AS flows, sum(byte_count)::BIGINT AS bytes FROM fl GROUP BY 1")),
    "scan_windows": (_windows, _sql("SELECT * FROM win")),
    "scan_summary": (lambda s, d: scan.scan_summary(_flows(s, d)), "WITH " + flows_sql().replace("q AS", "q AS", 1) + " SELECT initial_syn_sender_ip, FACTS FROM q GROUP BY 1"),
    "strict_windows": (_strict, _sql("SELECT * FROM st")),
    "scan_sources": (lambda s, d: scan.scan_sources(_strict(s, d)), _sql("SELECT * FROM src")),
    "flow_labels": (lambda s, d: _labelled(s, d).select("flow_id", "strict_removed", "broad_removed"), _sql("SELECT flow_id, strict_removed, broad_removed FROM lab")),
    "inclusion": (lambda s, d: _labelled(s, d).select("flow_id", F.lit(True).alias("raw_included"), (~F.col("strict_removed")).alias("strict_included"), (~F.col("broad_removed")).alias("broad_included")), _sql("SELECT flow_id, true AS raw_included, NOT strict_removed AS strict_included, NOT broad_removed AS broad_included FROM lab")),
    "threshold_sweep": (lambda s, d: scan.threshold_sweep(_windows(s, d), [(1, 1), (2, 2), (3, 2), (5, 3)]), _sql("SELECT n, m, count(*) FILTER (hit) AS windows, count(DISTINCT CASE WHEN hit THEN initial_syn_sender_ip END) AS sources FROM (SELECT *, syn_synack_rst_count >= 1 OR (syn_to_rst_count >= n AND syn_to_rst_unique_targets >= m) AS hit FROM win, (VALUES (1, 1), (2, 2), (3, 2), (5, 3)) t(n, m)) GROUP BY 1, 2")),
    "prefix_ledger": (lambda s, d: prefixes.ledger(_candidates(s, d)).drop("net"), _sql("SELECT * EXCLUDE (net) FROM ledger", ledger=True)),
    "membership_native": (_members, _sql("SELECT * FROM mem", ledger=True)),
    "membership_24": (lambda s, d: _members(s, d, "normalized_24"), _sql("SELECT * FROM mem24", ledger=True)),
    "membership_audit": (_audit, _sql("SELECT sum(k)::BIGINT AS rows, count(*) AS unique_flows, (sum(k) - count(*))::BIGINT AS extra_memberships, count(*) FILTER (k > 1) AS multi_prefix_flows FROM (SELECT flow_id, count(*) AS k FROM mem GROUP BY 1)", ledger=True)),
    "flow_length_freq": (lambda s, d: distribution.frequencies(_labelled(s, d), _members(s, d)), _sql("SELECT * FROM freq", ledger=True)),
    "flow_length_quantiles": (lambda s, d: distribution.quantiles(_cond(s, d)).select("target", "condition", "flows", "packets", *[F.round(c, 6).alias(c) for c in ("median", "p95", "mean")]), _sql("SELECT target, condition, count(*) AS flows, sum(packet_count)::DOUBLE AS packets, round(quantile_cont(packet_count, 0.5), 6) AS median, round(quantile_cont(packet_count, 0.95), 6) AS p95, round(avg(packet_count), 6) AS mean FROM (SELECT target, condition, packet_count, unnest(range(n)) FROM cond) GROUP BY 1, 2", ledger=True)),
    "flow_length_histogram": (lambda s, d: distribution.histogram(_cond(s, d)), _sql(HIST, ledger=True)),
    "ecdf_exact": (lambda s, d: distribution.ecdf(_cond(s, d), ["target", "condition"]), _sql("SELECT *, cumulative_count / total_flow_count::DOUBLE AS cumulative_fraction FROM ec", ledger=True)),
    "ks_distance": (lambda s, d: distribution.ks(_cond(s, d), ["target"], "condition", "raw", "retained"), _sql(KS, ledger=True)),
    "flow_jaccard": (_jaccard, _sql(JACCARD)),
    "coverage": (_coverage, _sql("SELECT " + ", ".join(f"round(sum(CASE WHEN flow_id IN (SELECT flow_id FROM mem) THEN {c} ELSE 0 END) / sum({c})::DOUBLE, 9) AS {n}_coverage" for c, n in (("1", "flow"), ("packet_count", "packet"), ("byte_count", "byte"))) + " FROM lab", ledger=True)),
    "host_counts": (_hosts, _sql(HOSTS, ledger=True)),
    "condition_summary": (_condition, _sql(f"SELECT name AS condition, count(*) AS flows, sum(packet_count)::BIGINT AS packets, sum(byte_count)::BIGINT AS bytes, round(median(packet_count), 6) AS median_packets, round(median(byte_count), 6) AS median_bytes, round(median(duration), 4) AS median_duration FROM {_c3} GROUP BY 1")),
    "removal_summary": (_removal, _sql("SELECT analysis_prefix, count(*) AS raw_flows, count(*) FILTER (strict_removed) AS strict_removed_flows, count(*) FILTER (broad_removed) AS broad_removed_flows, round(count(*) FILTER (broad_removed) / count(*)::DOUBLE, 9) AS broad_rate FROM mem JOIN lab USING (flow_id) GROUP BY 1", ledger=True)),
    "receiver_port_topn": (lambda s, d: scan.qualifying(_flows(s, d)).groupBy(F.col("initial_syn_receiver_port").alias("port")).agg(F.count(F.lit(1)).alias("flows"), F.countDistinct("initial_syn_receiver_ip").alias("receivers")).orderBy(F.desc("flows"), "port").limit(10), _sql("SELECT initial_syn_receiver_port AS port, count(*) AS flows, count(DISTINCT initial_syn_receiver_ip) AS receivers FROM q GROUP BY 1 ORDER BY flows DESC, port LIMIT 10")),
    "sender_diversity": (_diversity, _sql("SELECT initial_syn_sender_ip, count(DISTINCT initial_syn_receiver_ip) AS ips, count(DISTINCT initial_syn_receiver_port) AS ports, count(DISTINCT initial_syn_receiver_ip || ':' || initial_syn_receiver_port) AS targets FROM q GROUP BY 1")),
    "dominant_pattern": (_dominant, _sql(", c AS (SELECT initial_syn_sender_ip, observed_tcp_pattern AS p, count(*) AS n FROM q GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY initial_syn_sender_ip) AS top FROM c) SELECT initial_syn_sender_ip, max(n) AS n, CASE WHEN count(*) > 1 THEN 'tie' ELSE any_value(p) END AS dominant_pattern FROM m WHERE n = top GROUP BY 1")),
    "duration_profile": (lambda s, d: _flows(s, d).groupBy("observed_tcp_pattern").agg(F.count_if(F.col("duration") == 0).alias("zero"), F.count_if(F.col("duration") >= 1).alias("ge_1"), F.count_if(F.col("duration") >= 100).alias("ge_100"), F.min("duration").alias("min_s"), F.max("duration").alias("max_s")), _sql("SELECT observed_tcp_pattern, count(*) FILTER (duration = 0) AS zero, count(*) FILTER (duration >= 1) AS ge_1, count(*) FILTER (duration >= 100) AS ge_100, min(duration) AS min_s, max(duration) AS max_s FROM fl GROUP BY 1")),
    "legacy_score_topk": (_legacy, _sql(LEGACY, ledger=True)),
    "exclusive_contribution": (_exclusive, _sql(", dg AS (SELECT flow_id, count(*) AS degree FROM mem GROUP BY 1) SELECT analysis_prefix, count(*) AS flows, count(*) FILTER (degree = 1) AS exclusive_flows FROM mem JOIN dg USING (flow_id) GROUP BY 1", ledger=True)),
    "hhh_residuals": (_heavy, _sql(HEAVY)),
    "tuple_context": (_tuple, _sql(TUPLE, "259200")),
    "source_context": (_source, _sql(SOURCE, "259200")),
}
