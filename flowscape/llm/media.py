"""Motion-JPEG AVI columns: lossless storage of bytes as frames, RIFF parsing, shot detection.

``encode_avi`` stores a payload (a positive multiple of FRAME bytes) as an AVI file whose
frames are baseline grey JPEGs.  Every payload byte is the DC value of one 8x8 block (the DC
quantiser is 8, so the block is flat at exactly that sample value) and all AC values are
zero; any baseline decoder returns the bytes unchanged.  The Huffman code gives difference
category c a code of 9-c bits, so each block takes exactly ten bits (code, c magnitude bits,
one end-of-block bit) and whole frames are packed and unpacked as arrays.

``parse_avi`` walks the RIFF chunks, finds the frames through the ``idx1`` index (offsets from the
movi list or from the file's start) or, without one, by walking the movi list and its ``rec`` lists, and reads
``avih`` for the frame time.  ``decode_image`` decodes any baseline intra frame with its tables:
grey or colour, any sampling, restart markers; ``decode_frame`` gives its luminance by 8x8 blocks.  Frames of
``encode_avi`` take a path worked in arrays.  ``shots`` compares
histograms of neighbouring frames against a threshold that adapts to the file (``k`` times
the mean of its differences); ``clips`` are the timed rows.

Null and empty texts become one frame of padding.  Equal texts give equal files, so repeated
rows agree; empty tables give empty results; extra columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text

SIDE = 24
FRAME = SIDE * SIDE
PIXELS = 8 * SIDE
FPS = 25


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length), by the standard's canonical rule."""
    out, code, last = {}, 0, 0
    for symbol in sorted(lengths, key=lambda s: lengths[s]):
        code <<= lengths[symbol] - last if last else 0
        out[symbol], last = (code, lengths[symbol]), lengths[symbol]
        code += 1
    return out


DC_LENGTHS = {c: 9 - c for c in range(8, -1, -1)}


def _dc_codes() -> np.ndarray:
    """Ten-bit code of each difference -255..255 (index + 255)."""
    codes, table = _canonical(DC_LENGTHS), np.zeros(511, np.uint16)
    for diff in range(-255, 256):
        c = abs(diff).bit_length()
        code, _ = codes[c]
        extra = diff if diff >= 0 else diff + (1 << c) - 1
        table[diff + 255] = ((code << c) | extra) << 1
    return table


CODES = _dc_codes()
DIFFS = np.full(1024, 9999, np.int16)
DIFFS[CODES] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: lengths[s])
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return bytes([kind << 4]) + counts + bytes(order)


JPEG_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + bytes([8] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, PIXELS, PIXELS, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, _huffman(0, DC_LENGTHS))
    + _segment(0xC4, _huffman(1, {0: 1}))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of an array (frames, FRAME) of uint8."""
    values = samples.astype(np.int16) - 128
    diffs = np.diff(values, axis=1, prepend=np.int16(0))
    code = CODES[diffs + 255].reshape(len(samples), -1, 4).astype(np.uint64)
    word = (code[..., 0] << np.uint64(30)) | (code[..., 1] << np.uint64(20)) | (code[..., 2] << np.uint64(10)) | code[..., 3]
    packed = np.ascontiguousarray(word.astype(">u8")).view(np.uint8).reshape(len(samples), -1, 8)[..., 3:].reshape(len(samples), -1)
    return [JPEG_HEAD + row.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for row in packed]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def wrap_avi(frames: list[bytes], fps: int = FPS) -> bytes:
    """RIFF AVI file of the frames, with its index."""
    longest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, longest * fps, 0, 0x10, len(frames), 0, 1, longest, PIXELS, PIXELS, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, len(frames), longest, -1, 0, 0, 0, PIXELS, PIXELS)
    strf = struct.pack("<IiiHH4sIiiII", 40, PIXELS, PIXELS, 1, 24, b"MJPG", 3 * PIXELS * PIXELS, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def encode_avi(payload: bytes) -> bytes:
    return wrap_avi(encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, FRAME)))


def pad(text: bytes, unit: int = FRAME) -> bytes:
    """Bytes 255 up to a positive multiple of the unit."""
    return text + b"\xff" * (max(1, -(-len(text) // unit)) * unit - len(text))


def parse_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames in index order, and seconds per frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, seconds, at = None, None, 1.0 / FPS, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8, min(len(data), at + 8 + size)
        elif name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            seconds = struct.unpack_from("<I", data, at + 20)[0] / 1e6
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", min(size, len(data) - at - 8) // 16 * 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if movi is None:
        raise ValueError("no movi list")
    if index is None or not len(index):
        return list(_walk(data, movi[0] + 4, movi[1])), seconds
    found = [(int(offset), int(size)) for tag, _, offset, size in index.tolist() if _is_frame(tag.to_bytes(4, "little"))]
    # Offsets count from the list's name in most files, from the start of the file in some.
    base = movi[0]
    if found and not _is_frame(data[base + found[0][0] : base + found[0][0] + 4]):
        base = 0
    return [data[base + o + 8 : base + o + 8 + n] for o, n in found], seconds


def _is_frame(name: bytes) -> bool:
    return len(name) == 4 and name[2:] in (b"dc", b"db")


def _walk(data: bytes, at: int, end: int) -> Iterator[bytes]:
    """Frames of a list of chunks, those of lists inside it too."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST":
            yield from _walk(data, at + 12, min(end, at + 8 + size))
        elif _is_frame(name):
            yield data[at + 8 : min(end, at + 8 + size)]
        at += 8 + size + size % 2


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Block samples (frames, FRAME) of frames written by encode_frames; whole batch at once."""
    head, size = len(JPEG_HEAD), FRAME * 10 // 8
    scans = []
    for f in frames:
        scan = f[head:-2].replace(b"\xff\0", b"\xff") if f.startswith(JPEG_HEAD) else b""
        if len(scan) != size:
            return np.stack([decode_frame(f) for f in frames])
        scans.append(scan)
    raw = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 5).astype(np.uint64)
    word = (raw[:, 0] << np.uint64(32)) | (raw[:, 1] << np.uint64(24)) | (raw[:, 2] << np.uint64(16)) | (raw[:, 3] << np.uint64(8)) | raw[:, 4]
    code = np.stack([(word >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).astype(np.int64)
    diffs = DIFFS[code].reshape(len(frames), FRAME)
    if (diffs == 9999).any():
        raise ValueError("broken scan")
    return (np.cumsum(diffs, axis=1, dtype=np.int32) + 128).astype(np.uint8)


def _zigzag() -> list[int]:
    """Place in the block of each coefficient in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return [8 * r + c for r, c in cells]


ZIGZAG = _zigzag()
_WAVE = np.array([[(np.sqrt(1 / 8) if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


class _Bits:
    """Bits of one stretch of a scan, between restart markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\0", b"\xff"), 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            # Behind the end a scan is padded with ones.
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 255)
            self.at += 1
            self.n += 8
            if self.at > len(self.data) + 16:
                raise ValueError("short scan")
        self.n -= n
        value = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return value

    def symbol(self, table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("broken code")

    def value(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def decode_image(data: bytes) -> np.ndarray:
    """Samples of a baseline JPEG frame: (height, width) if grey, (height, width, 3) RGB if it has three components."""
    codes, quant, parts, shape, restart, at = {}, {}, [], (0, 0), 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        if at + 4 > len(data) or data[at] != 255:
            raise ValueError("broken frame")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                quant[body[0] & 15] = values.astype(float)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                code, symbols, table = 0, iter(body[17:]), {}
                for n in range(1, 17):
                    for _ in range(body[n]):
                        table[n, code] = next(symbols)
                        code += 1
                    code <<= 1
                codes[body[0]] = table
                body = body[17 + len(table) :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8 or body[5] not in (1, 3):
                raise ValueError("only 8 bits, grey or three components")
            shape = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline frames")
        elif marker == 0xDA:
            break
    tables = {body[1 + 2 * i]: (codes[body[2 + 2 * i] >> 4], codes[16 + (body[2 + 2 * i] & 15)]) for i in range(body[0])}
    end = data.rfind(b"\xff\xd9")
    stretches = re.split(rb"\xff[\xd0-\xd7]", data[at : end if end >= at else len(data)])
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-shape[1] // (8 * most_h)), -(-shape[0] // (8 * most_v))
    planes = [np.zeros((down * v * 8, across * h * 8)) for _, h, v, _ in parts]
    bits, dc = None, [0] * len(parts)
    for mcu in range(across * down):
        if bits is None or restart and mcu % restart == 0:
            turn = mcu // restart if restart else 0
            if turn >= len(stretches):
                raise ValueError("short scan")
            bits, dc = _Bits(stretches[turn]), [0] * len(parts)
        for i, (name, h, v, q) in enumerate(parts):
            dc_codes, ac_codes = tables[name]
            for b in range(h * v):
                block = np.zeros(64)
                dc[i] += bits.value(bits.symbol(dc_codes))
                block[0] = dc[i] * quant[q][0]
                k = 1
                while k < 64:
                    s = bits.symbol(ac_codes)
                    k += s >> 4
                    if not s & 15:
                        if s >> 4 != 15:
                            break
                    elif k < 64:
                        block[ZIGZAG[k]] = bits.value(s & 15) * quant[q][k]
                    k += 1
                y, x = (mcu // across * v + b // h) * 8, (mcu % across * h + b % h) * 8
                planes[i][y : y + 8, x : x + 8] = _WAVE.T @ block.reshape(8, 8) @ _WAVE + 128
    full = [np.repeat(np.repeat(p, most_v // v, axis=0), most_h // h, axis=1)[: shape[0], : shape[1]] for p, (_, h, v, _) in zip(planes, parts, strict=True)]
    if len(full) == 1:
        return np.clip(np.rint(full[0]), 0, 255).astype(np.uint8)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)), 0, 255).astype(np.uint8)


def decode_frame(data: bytes) -> np.ndarray:
    """Mean luminance of the 8x8 blocks of any baseline frame, in row order (the general path)."""
    image = decode_image(data).astype(float)
    if image.ndim == 3:
        image = image @ np.array([0.299, 0.587, 0.114])
    high, wide = (-(-n // 8) for n in image.shape)
    image = np.pad(image, ((0, 8 * high - image.shape[0]), (0, 8 * wide - image.shape[1])), mode="edge")
    return np.rint(image.reshape(high, 8, wide, 8).mean(axis=(1, 3))).astype(np.uint8).ravel()


def shots(samples: np.ndarray, k: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """Frame ranges [start, end) of the shots.  A cut lies where the histogram difference
    (half the L1 distance of 16-bin histograms, 0 to 1) exceeds both ``least`` and ``k`` times
    the mean of the file's differences."""
    n = len(samples)
    if n < 2:
        return [(0, n)]
    bins = (samples >> 4).astype(np.int64) + 16 * np.arange(n)[:, None]
    hist = np.bincount(bins.ravel(), minlength=16 * n).reshape(n, 16)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * samples.shape[1])
    cuts = np.flatnonzero(diff > max(least, k * diff.mean())) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


SCHEMA = "doc_id long, n_bytes long, media binary"


def store_media(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One AVI file a row: doc_id, n_bytes (without padding), media."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in _slices([len(v.as_buffer() or b"") for v in texts]):
                bodies = [texts[i].as_py().encode("utf-8", "surrogatepass") for i in part]
                padded = [pad(b) for b in bodies]
                frames = encode_frames(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, FRAME))
                files, at = [], 0
                for p in padded:
                    files.append(wrap_avi(frames[at : at + len(p) // FRAME]))
                    at += len(p) // FRAME
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop].cast(pa.int64()), pa.array([len(b) for b in bodies], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), clean_text(text).alias("text")).mapInArrow(write, SCHEMA)


def _slices(sizes: list[int], most: int = 8 << 20) -> Iterator[range]:
    """Row ranges of at most so many bytes (one row at least): bounds a task's memory."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield range(start, i)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield range(start, len(sizes))


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows: doc_id, clip, start_frame, end_frame, start_s, end_s."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, data in zip(pdf.doc_id, pdf.media, strict=True):
                frames, seconds = parse_avi(bytes(data))
                for i, (a, b) in enumerate(shots(decode_frames(frames))):
                    rows.append((key, i, a, b, a * seconds, b * seconds))
            yield pd.DataFrame(rows, columns=["doc_id", "clip", "start_frame", "end_frame", "start_s", "end_s"])

    return media.select("doc_id", "media").mapInPandas(cut, "doc_id long, clip int, start_frame int, end_frame int, start_s double, end_s double")


OP6_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips int, clips array<struct<start_s:double,end_s:double>>"


def op6_media(spark, sf_dir: str) -> DataFrame:
    """The contract's columns and the timed clips, computed from the stored files read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2)
            out = []
            for part in _slices([v.as_buffer().size for v in media]):
                files = [media[i].as_py() for i in part]
                split = [parse_avi(f) for f in files]
                samples = decode_frames([f for frames, _ in split for f in frames])
                at = 0
                for data, (frames, seconds) in zip(files, split, strict=True):
                    own = samples[at : at + len(frames)]
                    at += len(frames)
                    payload = own.tobytes()
                    found = shots(own)
                    longest = max(b - a for a, b in found)
                    feature = f"frames={len(frames)};shots={len(found)};longest={longest * seconds:.2f}s;mean={own.mean():.3f}"
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(found), [{"start_s": a * seconds, "end_s": b * seconds} for a, b in found]))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_clips", "clips"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return store_media(docs).mapInArrow(read, OP6_SCHEMA)
