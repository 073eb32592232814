"""Golden cases of the flow operators."""

import random

from flowscape.operators.flows import build_flows

SCHEMA = "packet_index long, ts double, protocol int, src_ip string, src_port int, dst_ip string, dst_port int, flags int, payload_bytes long, frame_bytes long"
A, B = ("10.0.0.1", 1000), ("10.0.0.2", 80)


def _packet(i, ts, src, dst, flags, payload=0):
    return (i, ts, 6, *src, *dst, flags, payload, 54 + payload)


def _one(spark, rows, timeout=None):
    return build_flows(spark.createDataFrame(rows, SCHEMA), timeout).orderBy("flow_id").collect()


def test_patterns(spark):
    assert _one(spark, [_packet(1, 1.0, A, B, 2), _packet(2, 1.1, B, A, 20)])[0].observed_tcp_pattern == "syn_to_rst"
    assert _one(spark, [_packet(1, 2.0, A, B, 2), _packet(2, 2.1, B, A, 18), _packet(3, 2.2, A, B, 20)])[0].observed_tcp_pattern == "syn_synack_rst"
    assert _one(spark, [_packet(1, 4.0, A, B, 2)])[0].observed_tcp_pattern == "syn_only_observed"
    full = _one(spark, [_packet(1, 3.0, A, B, 2), _packet(2, 3.1, B, A, 18), _packet(3, 3.2, A, B, 16), _packet(4, 3.3, A, B, 24, 5)])[0]
    assert full.observed_tcp_pattern == "none" and full.ack_after_synack_observed and full.transport_payload_observed


def test_equal_gap_does_not_split(spark):
    rows = [_packet(1, 0.0, A, B, 16), _packet(2, 60.0, B, A, 16), _packet(3, 120.5, A, B, 16)]
    assert [r.packet_count for r in _one(spark, rows, 60.0)] == [2, 1]
    assert len(_one(spark, rows)) == 1


def test_sessions_do_not_depend_on_blocks(spark, monkeypatch):
    """Gaps inside a block of the capture and between blocks count alike."""
    from flowscape.operators import flows

    rng = random.Random(4)
    rows, ts = [], 0.0
    for k in range(300):
        ts += rng.choice([1.0, 9.0, 10.0, 10.5])
        rows.append((k, ts, 6, f"10.0.0.{k % 3}", 1, "10.0.1.1", 2, 16, 0, 60))
    df = spark.createDataFrame(rows, "packet_index long, ts double, protocol int, src_ip string, src_port int, dst_ip string, dst_port int, flags int, payload_bytes long, frame_bytes long")
    want = set()
    for ip in range(3):
        own = [r for r in rows if r[3] == f"10.0.0.{ip}"]
        starts = [own[0][0]] + [b[0] for a, b in zip(own, own[1:]) if b[1] - a[1] > 20.0]
        want |= set(starts)
    for block in (100_000, 7):
        monkeypatch.setattr(flows, "BLOCK", block)
        got = build_flows(df, 20.0).collect()
        assert {r.flow_id for r in got} == want and sum(r.packet_count for r in got) == 300
