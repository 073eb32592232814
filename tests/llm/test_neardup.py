"""Near duplicates against all pairs, and rows with unusual ids and texts."""

from collections import Counter

import numpy as np
import pytest

from flowscape.llm import neardup
from flowscape.llm.common import PIECE, word_hashes

SCHEMA = "doc_id long, text string"
RNG = np.random.default_rng(3)
VOCAB = ["".join(chr(97 + c) for c in RNG.integers(0, 26, RNG.integers(3, 9))) for _ in range(400)]


def _text(n, seed):
    return " ".join(VOCAB[i] for i in np.random.default_rng(seed).integers(0, 400, n))


def _edited(groups, members, words, seed):
    """Groups of copies with up to ``members`` edits, so that pairs lie on both sides of 0.8."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = _text(words, 50 + g).split()
        for k in range(members):
            own = list(base)
            for at in rng.integers(0, len(own), 1 + k % 5):
                own[at] = f"edit{rng.integers(1000)}"
            rows.append((1000 * g + k, " ".join(own)))
    return rows


def _brute(rows):
    bags = []
    for _, t in rows:
        w = t.lower().split()
        n = min(5, len(w))
        bags.append(Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else Counter())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            either = sum((bags[i] | bags[j]).values())
            if root[i] != root[j] and (rows[i][1] == rows[j][1] or either and sum((bags[i] & bags[j]).values()) >= 0.8 * either):
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, d), d)
    return {d: least[r] for (d, _), r in zip(rows, root, strict=True)}


@pytest.mark.parametrize("large, size", [(4096, 8 << 20), (6, 1 << 12)])
def test_classes_equal_all_pairs(spark, monkeypatch, large, size):
    """Also where buckets are dealt in blocks of a few nodes or of 4 KB."""
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "BYTES", size)
    rows = _edited(6, 40, 100, 8)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == _brute(rows)
    assert len(set(got.values())) > 6  # some copies are under 0.8 of all others


def test_a_link_of_two_stragglers_is_found(spark):
    """Only one pair of two groups reaches 0.8; neither is its bucket's least node."""
    rows = _edited(1, 30, 100, 5)
    near, far = rows[7][1].split(), rows[7][1].split()
    far[50:54] = ["new1", "new2", "new3", "new4"]
    rows.append((5000, " ".join(far)))
    assert near != far
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _brute(rows)


def test_unusual_rows(spark):
    one, other = _text(60, 1), _text(60, 2)
    rows = [(None, other), (None, other), (None, "zz"), (1, one), (1, other + " end"), (2, one), (3, None), (4, ""), (5, " \n "), (6, "short one"), (7, "Short  one")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as node", "2 as label", "'b' as bucket")
    found = neardup.near_duplicates(df).collect()
    assert len(found) == len(rows)
    by = Counter((r.doc_id, r.class_id) for r in found)
    assert by == Counter([(None, 1), (None, 1), (None, None), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6)])
    assert len({r.class_key for r in found}) == 6  # one, other, zz, empty, white space, short one
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, 1, 1, 3, 5, 6])
    assert neardup.near_duplicates(df.limit(0)).count() == 0 and neardup.keep_one(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """Two texts of 600 KB, one word of 200 KB among them, read in pieces."""
    long = _text(60_000, 4) + " " + "x" * (3 * PIECE + 5) + " " + _text(9_000, 5)
    rows = [(1, long), (2, long.replace(" ", " y ", 2_000)), (3, long[: len(long) // 2])]
    assert len(long) > 6 * PIECE
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _brute(rows) == {1: 1, 2: 1, 3: 3}


def test_word_hashes_do_not_depend_on_pieces():
    words = [VOCAB[i % 400] + str(i) for i in range(30_000)] + ["q" * (2 * PIECE + 17), "end"]
    hashes, start, end = word_hashes(" ".join(words).encode())
    assert len(hashes) == len(words)
    text = " ".join(words)
    assert [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)] == words
    for i in (0, 9_999, 29_999, 30_000, 30_001):
        assert word_hashes(words[i].encode())[0][0] == hashes[i]
