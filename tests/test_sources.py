"""Captures, reports, addresses of both versions."""

import gzip
import ipaddress
import struct

import pytest
from pyspark.sql import functions as F

from flowscape.functions.ip import packed, version
from flowscape.operators.flows import build_flows
from flowscape.sources import capture, texts, wire

SIX = ("2001:db8::2", "2001:db8::1")
FRAMES = [
    (1.5, capture.frame_of("198.51.100.10", 40000, "192.0.2.10", 80, 6, 2, 60)),
    (2.25, capture.frame_of("192.0.2.10", 80, "198.51.100.10", 40000, 6, 18, 60)),
    (3.0, capture.frame_of(SIX[0], 53, SIX[1], 53000, 17, None, 70)),
    (4.0, capture.frame_of(SIX[1], 53000, SIX[0], 53, 17, None, 66)),
    (5.0, b"\0" * 12 + b"\x08\x06" + b"\0" * 30),  # ARP
    (6.0, capture.frame_of("192.0.2.1", 0, "192.0.2.2", 0, 1, None, 60)),  # ICMP
]
FRAGMENT = bytearray(FRAMES[0][1])
FRAGMENT[20:22] = struct.pack("!H", 100)


def _pcapng(frames, order="<"):
    block = lambda kind, body: struct.pack(order + "2I", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3xHH", 9, 1, 9, 0, 0))
    for ts, f in frames:
        stamp = round(ts * 10**9)
        out += block(6, struct.pack(order + "5I", 0, stamp >> 32, stamp & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


def _pcap(frames, original=None):
    return capture.write_pcap((ts, f, original or len(f)) for ts, f in frames)


@pytest.mark.parametrize("data", [_pcap(FRAMES), gzip.compress(_pcap(FRAMES)), _pcapng(FRAMES), _pcapng(FRAMES, ">")])
def test_formats_read_alike(data):
    got = list(capture.rows("x", data))
    assert [(r[1], r[2], r[3]) for r in got] == [(k + 1, ts, st) for k, ((ts, _), st) in enumerate(zip(FRAMES, ["ok"] * 4 + ["not_ip", "not_transport"], strict=True))]
    assert got[0][4:] == (4, 6, "198.51.100.10", 40000, "192.0.2.10", 80, 2, 6, 60, 60, 46)
    assert got[2][4:] == (6, 17, SIX[0], 53, SIX[1], 53000, None, 8, 70, 70, 56)


def test_skips_and_faults():
    assert [r[3] for r in capture.rows("x", _pcap([(1.0, bytes(FRAGMENT)), (2.0, FRAMES[0][1][:40])], 60))] == ["fragment", "truncated"]
    for bad in (_pcap(FRAMES)[:30], _pcap(FRAMES)[:-1], b"none", _pcap([(1.0, FRAMES[0][1][:40])]), _pcapng(FRAMES)[:-2]):
        with pytest.raises(capture.CaptureError):
            list(capture.rows("x", bad))
    with pytest.raises(capture.CaptureError, match="packet 2"):
        list(capture.rows("x", _pcap([FRAMES[0], (2.0, FRAMES[0][1][:40])])))


def test_files_to_flows(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(_pcap(FRAMES))
    decoded = capture.read_captures(spark, str(tmp_path))
    assert {r.status: r.packets for r in capture.skip_counts(decoded).collect()} == {"not_ip": 1, "not_transport": 1}
    assert capture.capture_start(decoded).first().capture_start == 1.5
    flows = {r.protocol: r for r in build_flows(capture.packets_of(decoded)).collect()}
    assert len(flows) == 2  # both directions of the IPv6 conversation are one flow
    assert flows[17].ip_version == 6 and flows[17].packets_from_src == 1 and flows[17].packets_from_dst == 1 and flows[17].src_ip == SIX[0]
    assert flows[6].synack_from_responder == 1 and flows[6].ip_byte_count == 92


def test_addresses(spark):
    names = ["1.2.3.4", "::", "::1", "2001:DB8:0:0:1::8", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1::", "1:2:3:4:5:6:7::", "1.2.3", "x", "", None, "1:2:3", "1::2::3", ":1:2:3:4:5:6:7", "12345::", "256.1.1.1", "1:::2"]

    def want(ip):
        try:
            return ipaddress.ip_address(ip).packed.hex()
        except ValueError:
            return None

    rows = spark.createDataFrame([(n,) for n in names], "ip string").select("ip", packed(F.col("ip")).alias("p"), version(F.col("ip")).alias("v")).collect()
    assert [(r.ip, r.p) for r in rows] == [(n, want(n)) for n in names]
    assert {r.ip: r.v for r in rows}["::1"] == 6


def test_mixed_versions_are_an_error(spark):
    df = spark.createDataFrame([(1, 1.0, 6, "1.2.3.4", 1, "::1", 2, 2, 0, 60)], "packet_index long, ts double, protocol int, src_ip string, src_port int, dst_ip string, dst_port int, flags int, payload_bytes long, frame_bytes long")
    with pytest.raises(Exception, match="mixes IP versions"):
        build_flows(df).collect()


REPORT = """% total: 846 bytes
[ 1] 198.51.100.30 192.0.2.0/24: 1,167 (19.74%)\t3 (20.00%)
\t[6:40002:8080] 60.00% 50.00% [17:1:2] 10.00% 5.50%
\t[6:1:2] 30.00% 44.50%

[ 2] * ::/0: 108 (12.77%)\t2 (13.33%)
"""


def test_reports(spark, tmp_path):
    (tmp_path / "r.txt").write_text(REPORT)
    got = texts.read_report(spark, str(tmp_path / "r.txt")).orderBy("aggregate_id").collect()
    assert [(r.aggregate_id, r.src_prefix, r.dst_prefix, r.bytes, r.packets, r.tcp_byte_ratio, r.udp_packet_ratio) for r in got] == [("1", "198.51.100.30", "192.0.2.0/24", "1167", "3", "90.00", "5.50"), ("2", "*", "::/0", "108", "2", "0.00", "0.00")]
    (tmp_path / "bad.txt").write_text(REPORT + "noise\n")
    with pytest.raises(Exception, match="not understood"):
        texts.read_report(spark, str(tmp_path / "bad.txt")).collect()


def _residuals(change=lambda parts: None):
    ip = lambda x: ipaddress.ip_address(x).packed.ljust(16, b"\0")
    protocol = wire.PROTOCOL.pack(ip("0.0.0.1"), ip("0.0.0.2"), 24, 24, 3, 300, 1)
    parts = [
        wire.HEADER.pack(wire.MAGIC, 4, 20, 0, 1, 1000, 0), b"BLK1", wire.BLOCK.pack(0, 5, 9, 5, 500, 2, 1, 1),
        wire.ADDRESS.pack(ip("10.0.0.0"), ip("0.0.0.0"), 24, 0, 5, 500, 2, 1, 2, 200, 1), protocol,
        b"SUM1", wire.COUNTS.pack(5, 500, 2), struct.pack("!2Q", 1, 1), b"END1", struct.pack("!Q", 1), wire.COUNTS.pack(5, 500, 2),
    ]
    change(parts)
    return b"".join(parts)


def test_residual_frames_are_audited(spark):
    said = wire.read_residuals(_residuals(), expected={"mode": "flow"})
    assert said["totals"] == {"packet": 5, "byte": 500, "flow": 2} and said["unattributed"] == {"packet": 2, "byte": 200, "flow": 1}
    rows = wire.residual_rows(spark.createDataFrame([("a", bytearray(_residuals()))], "path string, content binary")).collect()
    assert [(r.src_prefix, r.dst_prefix, r.flows) for r in rows] == [("10.0.0.0/24", "0.0.0.0/0", 2)]

    def swap(i, value):
        return lambda parts: parts.__setitem__(i, value)

    bad = [swap(0, wire.HEADER.pack(wire.MAGIC, 9, 20, 0, 1, 1, 0)), swap(2, wire.BLOCK.pack(1, 5, 9, 5, 500, 2, 1, 1)), swap(6, wire.COUNTS.pack(5, 500, 3)), swap(4, b""), swap(10, wire.COUNTS.pack(5, 1, 2)), lambda parts: parts.append(b"x"), swap(1, b"BLK2")]
    for change in bad:
        with pytest.raises(wire.WireError):
            wire.read_residuals(_residuals(change))
    with pytest.raises(wire.WireError, match="mode"):
        wire.read_residuals(_residuals(), expected={"mode": "byte"})


def test_records_refuse_what_they_cannot_hold(spark):
    schema = "flow_id long, ip_version int, protocol int, src_ip string, src_port int, dst_ip string, dst_port int, packet_count long, byte_count long, start_time double, end_time double"
    good = (1, 4, 6, "10.0.0.1", 1, "10.0.0.2", 2, 3, 400, 1.5, 2.5)
    six = (2, 6, 17, "::1", 1, "::2", 2, 1, 60, 1.0, 1.0)
    df = spark.createDataFrame([good, six], schema)
    back = wire.from_records(wire.to_records(wire.checked_flows(df))).collect()
    assert [tuple(r) for r in back] == [(1, "10.0.0.1", 1, "10.0.0.2", 2, 6, 3, 400, 1, 2)]
    assert tuple(wire.conversion_audit(df).first()) == (2, 1, 0, 1, 3, 400)
    for bad in ((*good[:7], 2**32, *good[8:]), (*good[:9], 3.0, 2.0), (*good[:4], 70000, *good[5:])):
        with pytest.raises(wire.WireError):
            wire.checked_flows(spark.createDataFrame([bad], schema))
    with pytest.raises(wire.WireError, match="twice"):
        wire.checked_flows(spark.createDataFrame([good, (2, *good[1:3], *good[5:7], *good[3:5], *good[7:])], schema))
    assert wire.checked_flows(spark.createDataFrame([good, (2, *good[1:])], schema), segmented=True).count() == 2
