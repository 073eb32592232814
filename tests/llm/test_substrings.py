"""External suffix order against plain sorting, and substring dedup against every 400-byte string."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from flowscape.llm import induced, substrings

SCHEMA = "doc_id long, text string"
RNG = np.random.default_rng(3)
VOCAB = ["".join(chr(97 + c) for c in RNG.integers(0, 26, RNG.integers(3, 9))) for _ in range(400)]


def _text(n, seed):
    return " ".join(VOCAB[i] for i in np.random.default_rng(seed).integers(0, 400, n))


def _shared(text, i, j, most):
    k = 0
    while k < most and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
        k += 1
    return k


@pytest.mark.parametrize("memory", [2048, 4096, 16384, 1 << 20])
def test_suffix_order_and_shared_prefixes(memory):
    rng = np.random.default_rng(memory)
    for k in range(40):
        a = rng.integers(1, rng.choice([2, 3, 6, 200]), rng.integers(1, 250))
        a = np.append(np.tile(a[:30], 7) if k % 3 == 0 else a, 0).astype(np.uint16)
        b, place, shared = a.tolist(), [], []
        for p, v in induced.descending(a, 400, memory):
            place += p.tolist()
            shared += v.tolist()
        want = sorted(range(len(b)), key=lambda i: b[i:], reverse=True)
        assert place == want
        assert shared[1:] == [_shared(b, x, y, 400) for x, y in zip(want, want[1:])]


def test_a_shard_many_times_its_memory():
    """600,000 characters in 1 MB: places, shared prefixes and names alone would take 15 MB."""
    text = "\0".join(_text(2_000, k % 70) for k in range(46)).encode()[:600_000]
    raw = np.append(np.frombuffer(text, np.uint8).astype(np.uint16) + 1, 0).astype(np.uint16)
    tracemalloc.start()
    n = sum(len(place) for place, _ in induced.descending(raw, 400, 1 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(raw)
    assert peak < 9 << 20


def _brute(rows):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + 400] for _, b in bodies for k in range(len(b) - 399))
    want = []
    for i, b in bodies:
        flag = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                flag[k : k + 400] = b"\1" * 400
        kept = bytes(c for c, f in zip(b, flag, strict=True) if not f)
        want.append((i, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(flag))), hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=str)


PASSAGE = _text(90, 11)
ROWS = [
    (1, None), (2, ""), (None, _text(150, 1)), (None, _text(150, 1)), (7, _text(150, 1)), (0, PASSAGE[:399]), (0, None),
    (8, _text(3000, 4) + " " + _text(150, 1)), (9, PASSAGE[:400]), (None, "é" + PASSAGE + "ü"), (11, "ab" * 700), (12, "é" * 500), (13, "x" * 399),
    *((20 + k, _text(20 + k, 30 + k) + " " + PASSAGE[k : 460 + k] + " " + _text(25, 60 + k)) for k in range(24)),
]


@pytest.mark.parametrize("large, window, shard", [(2_000, 1 << 18, 3 << 20), (1, 500, 1), (3, 4096, 2000)])
def test_equals_every_string(spark, monkeypatch, large, window, shard):
    """Also where each anchor is split, texts are hashed in small windows and shards are small."""
    for name, value in (("LARGE", large), ("WINDOW", window), ("SHARD", shard)):
        monkeypatch.setattr(substrings, name, value)
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("doc_id", "text", "1 as id", "2 as rid", "'a' as anchor")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(df).collect()), key=str)
    assert got == _brute(ROWS)
    assert substrings.dedup_substrings(df.limit(0)).count() == 0


def test_kept_bytes(spark):
    got = {r.doc_id: bytes(r.kept) for r in substrings.dedup_substrings(spark.createDataFrame([(1, PASSAGE + " one"), (2, "two " + PASSAGE)], SCHEMA)).collect()}
    assert got == {1: b" one", 2: b"two "}
