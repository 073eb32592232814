"""Base patterns against Python's, entropy against a plain window count, unusual rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowscape.llm import secrets

SCHEMA = "doc_id long, text string"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def _entropy(text, window):
    best = 0.0
    for a in range(len(text) - window + 1):
        best = max(best, -sum(n / window * math.log2(n / window) for n in Counter(text[a : a + window]).values()))
    return best


def _high(text):
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
        s = m[0]
        if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or re.search("(?i)(example|sample|changeme|placeholder|lorem|dummy)|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", s):
            continue
        least = next(bits for _, pattern, bits in secrets.CLASSES if re.match(pattern, s))
        if _entropy(s, secrets.WINDOW) >= least:
            out.append(("entropy", m.start(), m.end()))
    return out


def _texts():
    rng = random.Random(3)
    words = ["password", "Token", "api_key", "APIKEY", "secret", ":", "=", '"', "'", " ", "  ", "AKIA", "é", "␛", "\n", "word", "x" * 9, "0f" * 17, "ABCD1234EFGH5678", "a1b2c3d4e5f6g7h8i9j0", "Zx9/Qw3+Lk8_Pv2-Mn7=", "example1234567890abcdefgh", "123e4567-e89b-12d3-a456-426614174000", "a" * 25 + "1", "abab" * 6 + "1"]
    return [None, "", *("".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(400)), "z " * 50_000 + "password = hunter2hunter2"]


def test_spans_equal_plain_ones(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    some = 0
    for r in secrets.scan_secrets(df).collect():
        text = texts[r.doc_id] or ""
        assert [(s.kind, s.start, s.end) for s in r.base_spans] == _base(text), text
        order = ["assign", "access", "hex", "entropy"]
        want = sorted(_base(text) + _high(text), key=lambda x: (x[1], order.index(x[0])))
        assert [(s.kind, s.start, s.end) for s in r.secret_spans] == want, text
        some += any(s.kind == "entropy" for s in r.secret_spans)
    assert some > 50


def test_window_entropy(spark):
    rng = random.Random(9)
    rows = ["".join(rng.choices("abcdef0123456789", k=rng.randint(20, 60))) for _ in range(40)] + ["a" * 30, "ab" * 15]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", secrets._entropy(F.col("t"), 20).alias("e")).collect()
    for r in got:
        assert r.e == pytest.approx(_entropy(r.t, 20), abs=1e-9)


def test_redaction_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, 'é Password: "abcdefgh1" AKIA' + "B" * 12 + " " + "0f" * 16), (None, None), (2, "plain"), (2, "plain")], SCHEMA).selectExpr("*", "'mine' as base_spans", "7 as secret_spans")
    got = secrets.redact(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert rows[0].text.count("[REDACTED]") == 3 and "abcdefgh1" not in rows[0].text
    assert all(r.base_spans == "mine" and r.secret_spans == 7 for r in rows)
    assert Counter((r.doc_id, r.text) for r in rows[1:]) == Counter([(None, None), (2, "plain"), (2, "plain")])
    with pytest.raises(ValueError, match="base_spans"):
        secrets.scan_secrets(df)
    assert secrets.redact(df.limit(0)).count() == 0
