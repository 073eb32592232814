"""Captures of packets and records of flows whose address parts pass 255 and ports 65,535, as the events' large copies give them."""

import os
import struct

import duckdb
import pytest

from flowscape.plans import registry
from flowscape.sources import capture, wire

SF = "/root/testdata/sf0.001"
SHIFT = 88_500  # as in test_wide_ids
SIX = ("2001:db8::2", "2001:db8::1")
ENDS = [("10.0.354.1", 128_500, "192.168.3.22", 80, 6, 18, 90), ("192.168.3.22", 80, "10.2.70000.300", 2_000_000_000, 17, None, 60), ("10.0.1.2", 40_000, "192.168.0.1", 83, 6, 2, 54), (*SIX[:1], 53, *SIX[1:], 70_000, 17, None, 70)]


def _wide(link=None, cut=None, original=None):
    frames = [capture.wide_frame_of(*e)[:cut] for e in ENDS]
    return capture.write_pcap(((1.5 + k, f, original or len(f)) for k, f in enumerate(frames)), link or capture.WIDE)


def _pcapng():
    block = lambda kind, body: struct.pack("<2I", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    frame = capture.wide_frame_of(*ENDS[0])
    ethernet = frame[capture.OVER.size :]
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + b"".join(block(1, struct.pack("<HHI", link, 0, 0)) for link in (capture.ETHERNET, capture.WIDE))
    for k, f in enumerate((ethernet, frame)):
        out += block(6, struct.pack("<5I", k, 0, 0, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


def test_wide_records_hold_all_bits():
    got = list(capture.rows("x", _wide()))
    assert [r[5:10] for r in got] == [(e[4], *e[:4]) for e in ENDS]
    assert [r[10:] for r in got] == [(18, 36, 90, 90, 76), (None, 18, 60, 60, 46), (2, 0, 54, 54, 40), (None, 8, 70, 70, 56)]
    # An interface of each kind in one file: only the wide one has the header, and the other's frame is what its fields say.
    assert [r[6:10] for r in capture.rows("x", _pcapng())] == [("10.0.98.1", 128_500 - 65_536, *ENDS[0][2:4]), ENDS[0][:4]]


def test_wide_faults():
    assert {r[3] for r in capture.rows("x", _wide(cut=30, original=130))} == {"truncated"}  # within the header
    assert {r[3] for r in capture.rows("x", _wide(cut=60, original=130))} == {"truncated"}  # within the frame
    six = capture.OVER.pack(1, *[0] * 9) + capture.frame_of(SIX[0], 53, SIX[1], 53, 17, None, 70)
    for bad, what in ((_wide(cut=30), "packet 1: short wide"), (_wide(link=148), "link type 148"), (capture.write_pcap(iter([(1.0, six, len(six))]), capture.WIDE), "before IPv6")):
        with pytest.raises(capture.CaptureError, match=what):
            list(capture.rows("x", bad))
    for ip in ("10.0.1", "10.0.01.1", "10.0.-1.1", "10.0.1.x"):
        with pytest.raises(ValueError, match="not an IPv4 address"):
            capture.wide_frame_of(ip, 1, "10.0.0.1", 2, 6, 2, 54)


def test_only_captures_that_need_it_are_wide(spark):
    schema = "packet_index long, ts double, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, flags int, frame_bytes long"
    rows = [(k, float(k), *e) for k, e in enumerate([ENDS[2], ENDS[2], ENDS[2], ENDS[0], ENDS[1], ENDS[3]])]
    df = spark.createDataFrame(rows, schema)
    files = {r.path: bytes(r.content) for r in capture.to_captures(df, 2, wide=True).collect()}
    assert {p: struct.unpack_from("<I", c, 20)[0] for p, c in files.items()} == {"0": capture.ETHERNET, "1": capture.WIDE, "2": capture.WIDE}
    assert [r[6:10] for p in sorted(files) for r in capture.rows(p, files[p])] == [r[2:6] for r in rows]
    with pytest.raises(Exception, match="illegal IP address|argument out of range|format requires"):
        capture.to_captures(df, 2).collect()


def test_wide_flow_records(spark):
    schema = "flow_id long, ip_version int, protocol int, src_ip string, src_port int, dst_ip string, dst_port int, packet_count long, byte_count long, start_time double, end_time double"
    ends = [ENDS[2][:4], ENDS[0][:4], ("192.168.3.22", 80, "10.2.16777215.300", 2**31 - 1)]
    rows = [(k, 4, 6, *e, 3, 400, 1.5, 2.5) for k, e in enumerate(ends)]
    df = spark.createDataFrame(rows, schema)
    records = wire.to_records(wire.checked_flows(df, wide=True), wide=True)
    assert {r.flow_id: (len(r.record), r.record[36]) for r in records.collect()} == {0: (56, 4), 1: (56, wire.WIDE), 2: (56, wire.WIDE)}
    assert sorted(map(tuple, wire.from_records(records).collect())) == [(k, *e, 6, 3, 400, 1, 2) for k, e in enumerate(ends)]
    assert wire.pack_record(*(ends[0][i] for i in (0, 2, 1, 3)), 6, 3, 400, 1.5, 2.5, wide=True) == wire.pack_record(*(ends[0][i] for i in (0, 2, 1, 3)), 6, 3, 400, 1.5, 2.5)
    with pytest.raises(wire.WireError, match="flow 1: port out of range"):
        wire.checked_flows(df.where("flow_id = 1"))
    body = bytearray(wire.pack_record("10.0.354.1", "10.0.0.1", 1, 2, 6, 3, 400, 1, 2, wide=True))
    for at, value, what in ((15, 1, "spare bytes"), (36, 4, "not IPv4"), (36, 5, "not IPv4")):
        with pytest.raises(wire.WireError, match=what):
            wire.unpack_record(bytes(body[:at] + bytes([value]) + body[at + 1 :]))


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """The small events and a copy with shifted keys."""
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    made = tmp_path_factory.mktemp("wide")
    duckdb.connect().execute(f"COPY (SELECT event_id + 100000 * k AS event_id, ts, user_id + {SHIFT} * k AS user_id, event_type, value, props FROM '{SF}/events.parquet', range(2) t(k) ORDER BY event_id) TO '{made}/events.parquet' (FORMAT parquet)")
    return str(made)


@pytest.mark.parametrize("name", ["capture_packets", "capture_starts", "flow_records"])
def test_query_equals_oracle(spark, wide, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{wide}/events.parquet'")
    df = registry.queries()[name](spark, wide)
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
