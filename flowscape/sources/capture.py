"""Packet captures: PCAP and PCAPNG files to decoded packet rows, and rows back to a capture.

Files are read with Spark's binary reader, so any store it knows will do; each file is one task's work, since a
capture can only be read from its start.  A damaged file is an error that names the packet; a frame that is merely no TCP or UDP
gets a row with its status, so that skips can be counted.

Headers have 8 bits for a part of an IPv4 address and 16 for a port.  The test input has parts and ports over that; such packets can
be written as records of a private link type (``WIDE``), whose own header before the frame says what the fields lack.
"""

from __future__ import annotations

import gzip
import socket
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import gathered, spread

SCHEMA = (
    "file string, packet_index long, ts double, status string, ip_version int, protocol int, src_ip string, src_port int, dst_ip string, dst_port int, "
    "flags int, payload_bytes long, frame_bytes long, original_bytes long, ip_bytes long"
)
NAMES = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
KINDS = [TYPES[c.strip().split(" ")[1]] for c in SCHEMA.split(",")]

# Fixed values of the file formats: magic numbers with byte order and fractions of a second.
PCAP = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
SECTION, INTERFACE, PACKET, ENHANCED = 0x0A0D0D0A, 1, 2, 6
ETHERNET = 1
#: A link type kept for private use, so that no other reader takes these frames for what their fields say: an Ethernet frame behind a
#: header of what the parts of the source, those of the destination (zeros for IPv6) and the two ports have over their fields' bits.
WIDE, OVER = 147, struct.Struct("!10I")


class CaptureError(ValueError):
    """A capture that can't be read."""


def records(data: bytes) -> Iterator[tuple[float, bytes, int, tuple | None]]:
    """(timestamp, captured frame, original length, fields of a WIDE record's own header or None) of each record; gzip is opened."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if data[:4] in PCAP:
        yield from _pcap(data)
    elif data[:4] == struct.pack(">I", SECTION):
        yield from _pcapng(data)
    else:
        raise CaptureError("neither PCAP nor PCAPNG")


def _known(link: int) -> None:
    if link not in (ETHERNET, WIDE):
        raise CaptureError(f"link type {link} is not Ethernet")


def _bared(link: int, body: bytes, original: int, n: int) -> tuple[bytes, int, tuple | None]:
    """The frame without a WIDE record's own header, its original length, that header's fields."""
    if link == ETHERNET:
        return body, original, None
    if len(body) < OVER.size:
        if len(body) == original:
            raise CaptureError(f"packet {n}: short wide header")
        return b"", original, None  # cut off by the capture
    return body[OVER.size :], original - OVER.size, OVER.unpack_from(body)


def _pcap(data: bytes) -> Iterator[tuple[float, bytes, int, tuple | None]]:
    order, parts = PCAP[data[:4]]
    if len(data) < 24:
        raise CaptureError("short file header")
    link = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF
    _known(link)
    at, n = 24, 0
    while at < len(data):
        n += 1
        if at + 16 > len(data):
            raise CaptureError(f"packet {n}: short record header")
        seconds, fraction, size, original = struct.unpack_from(order + "4I", data, at)
        at += 16
        if size > original:
            raise CaptureError(f"packet {n}: captured length over original length")
        if at + size > len(data):
            raise CaptureError(f"packet {n}: short record body")
        yield seconds + fraction / parts, *_bared(link, data[at : at + size], original, n)
        at += size


def _pcapng(data: bytes) -> Iterator[tuple[float, bytes, int, tuple | None]]:
    at, n, order, links = 0, 0, "<", []
    while at < len(data):
        if at + 12 > len(data):
            raise CaptureError(f"after packet {n}: short block")
        if data[at : at + 4] == struct.pack(">I", SECTION):
            order, links = ("<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
            if data[at + 8 : at + 12] not in (b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"):
                raise CaptureError("unknown byte order")
        kind, size = struct.unpack_from(order + "2I", data, at)
        if size < 12 or size % 4 or at + size > len(data):
            raise CaptureError(f"after packet {n}: bad block length")
        if struct.unpack_from(order + "I", data, at + size - 4)[0] != size:
            raise CaptureError(f"after packet {n}: block trailer differs")
        body = data[at + 8 : at + size - 4]
        at += size
        if kind == INTERFACE:
            links.append((struct.unpack_from(order + "H", body)[0], _resolution(body[8:], order)))
        elif kind in (ENHANCED, PACKET):
            n += 1
            if len(body) < 20:
                raise CaptureError(f"packet {n}: short packet block")
            if kind == ENHANCED:
                interface, high, low, caught, original = struct.unpack_from(order + "5I", body)
            else:
                interface, _, high, low, caught, original = struct.unpack_from(order + "2H4I", body)
            if interface >= len(links):
                raise CaptureError(f"packet {n}: unknown interface")
            link, parts = links[interface]
            _known(link)
            if caught > original or 20 + caught + -caught % 4 > len(body):
                raise CaptureError(f"packet {n}: captured length out of bounds")
            stamp = (high << 32) + low
            yield stamp // parts + stamp % parts / parts, *_bared(link, body[20 : 20 + caught], original, n)


def _resolution(options: bytes, order: str) -> int:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "2H", options, at)
        if code == 9 and size:
            value = options[at + 4]
            return 2 ** (value & 127) if value & 128 else 10**value
        if not code:
            break
        at += 4 + size + -size % 4
    return 10**6


def decode(frame: bytes, original: int, index: int) -> tuple:
    """(status, ip_version, protocol, src_ip, src_port, dst_ip, dst_port, flags, payload_bytes, ip_bytes).

    Status is ok, not_ip, fragment (but the first), not_transport or truncated (cut off by the capture); a complete
    frame that is malformed is an error."""
    cut = len(frame) < original

    def short(what: str) -> tuple:
        if not cut:
            raise CaptureError(f"packet {index}: malformed {what}")
        return ("truncated", *[None] * 9)

    if len(frame) < 14:
        return short("Ethernet")
    kind, at = struct.unpack_from("!H", frame, 12)[0], 14
    while kind in (0x8100, 0x88A8):  # VLAN tags
        if len(frame) < at + 4:
            return short("VLAN tag")
        kind, at = struct.unpack_from("!H", frame, at + 2)[0], at + 4
    ip = frame[at:]
    if kind == 0x0800:
        if len(ip) < 20 or (ip[0] & 15) * 4 > len(ip) or ip[0] >> 4 != 4 or (ip[0] & 15) < 5:
            return short("IPv4")
        head, total = (ip[0] & 15) * 4, struct.unpack_from("!H", ip, 2)[0]
        if struct.unpack_from("!H", ip, 6)[0] & 0x1FFF:
            return ("fragment", *[None] * 9)
        version, protocol, family, src, dst = 4, ip[9], socket.AF_INET, ip[12:16], ip[16:20]
    elif kind == 0x86DD:
        if len(ip) < 40 or ip[0] >> 4 != 6:
            return short("IPv6")
        head, total, protocol = 40, 40 + struct.unpack_from("!H", ip, 4)[0], ip[6]
        version, family, src, dst = 6, socket.AF_INET6, ip[8:24], ip[24:40]
        while protocol in (0, 43, 44, 51, 60):  # extension headers
            if len(ip) < head + 8:
                return short("IPv6 extension")
            if protocol == 44 and struct.unpack_from("!H", ip, head + 2)[0] & 0xFFF8:
                return ("fragment", *[None] * 9)
            size = 8 if protocol == 44 else (ip[head + 1] + 2) * 4 if protocol == 51 else (ip[head + 1] + 1) * 8
            protocol, head = ip[head], head + size
    else:
        return ("not_ip", *[None] * 9)
    if protocol not in (6, 17):
        return ("not_transport", *[None] * 9)
    part = ip[head:total] if total else ip[head:]
    least = 20 if protocol == 6 else 8
    if len(part) < least:
        return short("TCP" if protocol == 6 else "UDP")
    if protocol == 6:
        least = (part[12] >> 4) * 4
        if least < 20 or least > len(part):
            return short("TCP")
    ports = struct.unpack_from("!2H", part)
    flags = struct.unpack_from("!H", part, 12)[0] & 0x1FF if protocol == 6 else None
    return "ok", version, protocol, socket.inet_ntop(family, src), ports[0], socket.inet_ntop(family, dst), ports[1], flags, len(part) - least, total


def rows(name: str, data: bytes) -> Iterator[tuple]:
    for index, (ts, frame, original, over) in enumerate(records(data), 1):
        status, version, protocol, src, sport, dst, dport, flags, payload, size = decode(frame, original, index)
        if over and status == "ok":
            if version == 6 and any(over[:8]):
                raise CaptureError(f"packet {index}: a wide header of IPv4 parts before IPv6")
            if version == 4:
                src, dst = (gathered(map(int, ip.split(".")), part) for ip, part in ((src, over[:4]), (dst, over[4:8])))
            sport, dport = sport + (over[8] << 16), dport + (over[9] << 16)
        yield name, index, ts, status, version, protocol, src, sport, dst, dport, flags, payload, len(frame), original, size


def decode_captures(files: DataFrame) -> DataFrame:
    """files(path, content) -> one row a record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = []
                for row in rows(name, content.as_py()):
                    held.append(row)
                    if len(held) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), KINDS, strict=True)], names=NAMES)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), KINDS, strict=True)], names=NAMES)

    return files.select("path", "content").mapInArrow(work, SCHEMA)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Decoded records of all capture files under a path."""
    return decode_captures(spark.read.format("binaryFile").load(path))


def packets_of(decoded: DataFrame) -> DataFrame:
    """The rows the flow operators take: TCP and UDP packets only."""
    return decoded.where("status = 'ok'").drop("status")


def skip_counts(decoded: DataFrame) -> DataFrame:
    """status, packets of what was not decoded."""
    return decoded.where("status <> 'ok'").groupBy("status").agg(F.count(F.lit(1)).alias("packets"))


def capture_start(decoded: DataFrame) -> DataFrame:
    """One row: timestamp of the first raw record of each file, whatever it holds."""
    return decoded.groupBy("file").agg(F.min_by("ts", "packet_index").alias("capture_start"))


def write_pcap(packets: Iterator[tuple[float, bytes, int]], link: int = ETHERNET) -> bytes:
    """A nanosecond PCAP of (timestamp, captured bytes, original length)."""
    out = [struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 262144, link)]
    for ts, frame, original in packets:
        seconds = int(ts)
        nanos = round((ts - seconds) * 10**9)
        out += [struct.pack("<4I", seconds + nanos // 10**9, nanos % 10**9, len(frame), original), frame]
    return b"".join(out)


def frame_of(src: str, sport: int, dst: str, dport: int, protocol: int, flags: int | None, size: int) -> bytes:
    """A frame of ``size`` bytes with these headers and zeros behind them."""
    six = ":" in src
    family = socket.AF_INET6 if six else socket.AF_INET
    ends = socket.inet_pton(family, src) + socket.inet_pton(family, dst)
    body = size - 14 - (40 if six else 20)
    if protocol == 6:
        inner = struct.pack("!HHIIHHHH", sport, dport, 0, 0, 5 << 12 | flags or 0, 0, 0, 0)
    else:
        inner = struct.pack("!4H", sport, dport, body, 0)
    if six:
        head = struct.pack("!IHBB", 6 << 28, body, protocol, 64) + ends
    else:
        head = struct.pack("!BBHHHBBH", 0x45, 0, size - 14, 0, 0, 64, protocol, 0) + ends
    return (b"\0" * 12 + (b"\x86\xdd" if six else b"\x08\x00") + head + inner).ljust(size, b"\0")


def _narrow(ip: str) -> tuple[str, tuple[int, ...]]:
    """The address with its parts cut to eight bits, and what they have over them."""
    if ":" in ip:
        return ip, (0,) * 4
    low, over = spread(ip)
    return ".".join(map(str, low)), over


def wide_frame_of(src: str, sport: int, dst: str, dport: int, protocol: int, flags: int | None, size: int) -> bytes:
    """``frame_of`` behind the header of a WIDE record; parts and ports may have 32 bits more than their fields."""
    (src, one), (dst, other) = _narrow(src), _narrow(dst)
    return OVER.pack(*one, *other, sport >> 16, dport >> 16) + frame_of(src, sport & 0xFFFF, dst, dport & 0xFFFF, protocol, flags, size)


def _packed(block: pd.DataFrame, wide: bool) -> bytes:
    """A capture of these packets."""
    flags = block["flags"].astype("Int64")
    over = wide and (max(block["src_port"].max(), block["dst_port"].max()) > 0xFFFF or any(any(_narrow(ip)[1]) for ip in {*block["src_ip"], *block["dst_ip"]}))
    make, own, link = (wide_frame_of, OVER.size, WIDE) if over else (frame_of, 0, ETHERNET)
    frames = ((r.ts, make(r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.protocol, None if pd.isna(f) else int(f), int(r.frame_bytes)), own + int(r.frame_bytes)) for r, f in zip(block.itertuples(index=False), flags, strict=True))
    return write_pcap(frames, link)


def to_captures(packets: DataFrame, each: int, wide: bool = False) -> DataFrame:
    """packets -> (path, content): a capture for every ``each`` packets in order.

    An address part over 255 or a port over 65,535 is an error; with ``wide`` the captures that hold one are of WIDE records."""

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [str(block["block"].iloc[0])], "content": [_packed(block.sort_values("packet_index", kind="stable"), wide)]})

    rows = packets.withColumn("block", F.floor(F.col("packet_index") / each))
    return rows.groupBy("block").applyInPandas(pack, "path string, content binary")  # at most ``each`` rows a group
