"""Media columns: exact round trip, general frames against a plain encoder, AVI variants, clips."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest

from flowscape.llm import media

SCHEMA = "doc_id long, text string"
TEXTS = [(1, None), (2, ""), (3, "é" * 400), (4, "plain " * 300), (4, "plain " * 300), (None, "no id"), (5, "long text " * 60_000)]


def test_query_equals_plain_digests(spark, tmp_path):
    spark.createDataFrame(TEXTS, SCHEMA).selectExpr("*", "1 as n_bytes", "'m' as media").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(media.op6_media(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    want = sorted(TEXTS, key=lambda r: (r[0] or 0, len(r[1] or "")))
    assert len(got) == len(want)
    for r, (i, t) in zip(got, want, strict=True):
        body = (t or "").encode()
        payload = media.pad(body)
        stored = media.encode_avi(payload)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(body), len(payload)) and len(payload) % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.n_clips == len(r.clips) and r.clips[0].start_s == 0.0 and r.clips[-1].end_s == pytest.approx(len(payload) / 576 / media.FPS, rel=1e-6)
        assert all(a.end_s == b.start_s for a, b in zip(r.clips, r.clips[1:]))


def test_every_decoder_agrees():
    samples = np.random.default_rng(1).integers(0, 256, (4, media.FRAME), dtype=np.uint8)
    frames = media.encode_frames(samples)
    assert (media.decode_frames(frames) == samples).all()
    for f, s in zip(frames, samples, strict=True):
        assert (media.decode_frame(f) == s).all()
        image = media.decode_image(f)
        assert image.shape == (192, 192) and (image[::8, ::8].ravel() == s).all()


def _encode(planes, sampling, restart):
    """A plain baseline encoder: quantiser 1, codes of one length."""
    wave = np.array([[(np.sqrt(1 / 8) if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
    scan, r, c, up = [], 0, 0, True
    while len(scan) < 64:  # walk the diagonals
        scan.append((r, c))
        if up:
            r, c, up = (r - 1, c + 1, True) if r and c < 7 else (r + 1, c, False) if c == 7 else (r, c + 1, False)
        else:
            r, c, up = (r + 1, c - 1, False) if c and r < 7 else (r, c + 1, True) if r == 7 else (r + 1, c, True)
    ac = [run << 4 | size for run in range(16) for size in range(1, 11)] + [0, 0xF0]
    bits = lambda v, n: format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""
    high, wide = planes[0].shape
    v0, h0 = sampling[0]
    out, last, stretches = "", [0] * len(planes), []
    for mcu in range((high // (8 * v0)) * (wide // (8 * h0))):
        if restart and mcu and mcu % restart == 0:
            stretches.append(out)
            out, last = "", [0] * len(planes)
        row, col = divmod(mcu, wide // (8 * h0))
        for i, (p, (v, h)) in enumerate(zip(planes, sampling, strict=True)):
            for b in range(v * h):
                y, x = (row * v + b // h) * 8, (col * h + b % h) * 8
                q = np.rint(wave @ (p[y : y + 8, x : x + 8] - 128) @ wave.T).astype(int)
                flat = [int(q[rc]) for rc in scan]
                d, last[i] = flat[0] - last[i], flat[0]
                n = abs(d).bit_length()
                out += format(n, "04b") + bits(d, n)
                run = 0
                end = max((k for k in range(1, 64) if flat[k]), default=0)
                for k in range(1, end + 1):
                    if not flat[k]:
                        run += 1
                        continue
                    while run > 15:
                        out, run = out + format(ac.index(0xF0), "08b"), run - 16
                    n = abs(flat[k]).bit_length()
                    out, run = out + format(ac.index(run << 4 | n), "08b") + bits(flat[k], n), 0
                if end < 63:
                    out += format(ac.index(0), "08b")
    stretches.append(out)
    body = b""
    for k, s in enumerate(stretches):
        s += "1" * (-len(s) % 8)
        body += int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + k % 8]) if k < len(stretches) - 1 else b"")
    seg = media._segment
    n = len(planes)
    return (
        b"\xff\xd8" + seg(0xDB, b"\0" + bytes([1] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, high, wide, n) + b"".join(bytes([i, h << 4 | v, 0]) for i, (v, h) in enumerate(sampling)))
        + seg(0xC4, bytes([0]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + bytes([16]) + bytes([0] * 7 + [len(ac)] + [0] * 8) + bytes(ac))
        + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, bytes([n]) + b"".join(bytes([i, 0]) for i in range(n)) + bytes([0, 63, 0])) + body + b"\xff\xd9"
    )


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_grey_frames_with_detail(restart):
    image = np.random.default_rng(2).integers(0, 256, (24, 40)).astype(float)
    got = media.decode_image(_encode([image], [(1, 1)], restart))
    assert np.abs(got - image).max() <= 4 and np.abs(got - image).mean() < 1


@pytest.mark.parametrize("luma", [(1, 1), (2, 2), (1, 2)])
def test_colour_frames(luma):
    rng = np.random.default_rng(3)
    v, h = luma
    y = rng.integers(60, 190, (32, 48)).astype(float)
    chroma = [np.full((32 // v, 48 // h), c) for c in (110.0, 150.0)]
    got = media.decode_image(_encode([y, *chroma], [luma, (1, 1), (1, 1)], 0)).astype(float)
    want = np.clip(np.stack([y + 1.402 * 22, y + 0.344136 * 18 - 0.714136 * 22, y - 1.772 * 18], axis=2), 0, 255)
    assert got.shape == (32, 48, 3) and np.abs(got - want).max() <= 4


def test_damaged_frames():
    good = media.encode_frames(np.zeros((1, media.FRAME), np.uint8))[0]
    for bad in (b"", b"none", good[:40], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, KeyError, struct.error)):
            media.decode_image(bad)


def test_avi_variants():
    payload = np.random.default_rng(4).integers(0, 256, 5 * media.FRAME, dtype=np.uint8).tobytes()
    data = media.encode_avi(payload)
    frames, seconds = media.parse_avi(data)
    assert len(frames) == 5 and seconds == 0.04 and media.decode_frames(frames).tobytes() == payload
    at, movi = data.index(b"idx1"), data.index(b"movi")
    absolute = bytearray(data)
    for k in range(5):
        place = at + 8 + 16 * k + 8
        struct.pack_into("<I", absolute, place, struct.unpack_from("<I", data, place)[0] + movi)
    assert media.parse_avi(bytes(absolute))[0] == frames
    assert media.parse_avi(data[:at])[0] == frames  # no index
    inner = media._chunk(b"LIST", b"rec " + b"".join(media._chunk(b"00dc", f) for f in frames[:2])) + media._chunk(b"01wb", b"sound") + media._chunk(b"LIST", b"rec " + b"".join(media._chunk(b"00dc", f) for f in frames[2:]))
    assert media.parse_avi(media._chunk(b"RIFF", b"AVI " + media._chunk(b"LIST", b"movi" + inner)))[0] == frames
    with pytest.raises(ValueError):
        media.parse_avi(b"RIFF0000WAVE")


def test_shots_and_clips(spark):
    still = np.concatenate([np.full((5, media.FRAME), 10, np.uint8), np.full((7, media.FRAME), 200, np.uint8)])
    assert media.shots(still) == [(0, 5), (5, 12)] and media.shots(still[:1]) == [(0, 1)]
    text = "a" * (5 * media.FRAME) + "\u00ff" * (3 * media.FRAME)
    stored = media.store_media(spark.createDataFrame([(1, text), (2, None)], SCHEMA))
    rows = sorted(media.clips(stored).collect(), key=lambda r: (r.doc_id, r.clip))
    assert [(r.doc_id, r.clip, r.start_frame, r.end_frame) for r in rows] == [(1, 0, 0, 5), (1, 1, 5, 11), (2, 0, 0, 1)]
    assert rows[1].start_s == pytest.approx(0.2) and re.match("CLIP|.", str(rows[0]))
    assert media.store_media(spark.createDataFrame([], SCHEMA)).count() == 0
