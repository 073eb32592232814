"""Benchmark leaks against the definition, long items, blocks of items, unusual rows."""

import numpy as np
import pytest

from flowscape.llm import decontaminate

DOCS = "doc_id long, text string"
RNG = np.random.default_rng(21)
VOCAB = ["".join(chr(97 + c) for c in RNG.integers(0, 26, RNG.integers(3, 9))) for _ in range(900)]


def _words(n, seed):
    return [VOCAB[i] for i in np.random.default_rng(seed).integers(0, len(VOCAB), n)]


def _lcs(one, other):
    row = [0] * (len(other) + 1)
    for a in one:
        last, row = row, [0]
        for j, b in enumerate(other):
            row.append(last[j] + 1 if a == b else max(row[-1], last[j + 1]))
    return row[-1]


def _leaks(text, item):
    """The definition: a run of at most 2n words of the text that passes both checks."""
    n, tail = len(item), item[-max(1, len(item) // 4) :]
    runs = [text[a : a + 2 * n] for a in range(max(1, len(text) - 2 * n + 1))]
    return any(_lcs(item, r) >= 0.7 * n - 1e-9 and _lcs(tail, r) >= 0.5 * len(tail) for r in runs)


def test_lcs():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)).tolist(), rng.integers(0, 6, rng.integers(1, 30)).tolist()
        assert decontaminate.lcs(a, b) == _lcs(a, b)


@pytest.mark.parametrize("slice_words, item_bytes", [(1 << 14, 32 << 20), (32, 600)])
def test_equals_the_definition(spark, monkeypatch, slice_words, item_bytes):
    """Copies, edits near both limits, stretched and cut copies; also in small slices and item blocks."""
    monkeypatch.setattr(decontaminate, "SLICE", slice_words)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    rng, items, rows = np.random.default_rng(4), {}, []
    for k in range(8):
        items[k] = _words(int(rng.integers(6, 24)), 100 + k)
    for d in range(64):
        own = list(items[d % 8])
        kind = d // 8
        for at in rng.permutation(len(own))[: int(len(own) * kind * 0.07)]:
            own[at] = f"edit{at}"
        if kind % 2:
            own = [w for x in own for w in ([x, "pad"] if rng.random() < 0.3 else [x])]
        if kind > 5:
            own = own[: int(len(own) * 0.8)]
        rows.append((d, _words(40, 500 + d) + own + _words(30, 700 + d)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], DOCS), bench).collect()}
    want = {(d, k) for d, w in rows for k, item in items.items() if _leaks(w, item)}
    assert got == want and 8 < len(want) < 60


def test_long_items(spark):
    """Items of 200 to 4,000 words, copied word for word and with a tenth of the words changed."""
    sizes = {k: _words(n, 40 + k) for k, n in enumerate((200, 1000, 2000, 4000))}
    rows = []
    for k, item in sizes.items():
        edited = [w + "x" if i % 10 == 3 else w for i, w in enumerate(item)]
        rows += [(k, " ".join(_words(300, 1) + item + _words(300, 2))), (10 + k, " ".join(_words(50, 3) + edited))]
    rows.append((20, " ".join(_words(9000, 9))))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in sizes.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert got == {(d, k) for k in sizes for d in (k, 10 + k)}


def test_unusual_rows(spark):
    item = _words(40, 7)
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (None, " ".join(_words(20, 8)))], "item_id long, text string")
    text = " ".join(_words(30, 6) + item)
    rows = [(None, text), (5, text), (5, text), (6, None), (7, ""), (8, " ".join(_words(20_000, 5) + item)), (9, " ".join(_words(20, 8)).upper())]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "0 as item_id", "1.0 as cosine")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()), key=str)
    assert got == sorted([(None, 1)] * 2 + [(5, 1)] * 4 + [(8, 1)] * 2 + [(9, None)], key=str)
    assert decontaminate.leaks(df.limit(0), bench).count() == 0
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_decontaminate_finds_every_item_of_a_large_benchmark(spark):
    """1,000 items, each copied into a long text, and edited in its rarest words in another."""
    rng = np.random.default_rng(12)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(6000)]
    weight = 1 / np.arange(20, 6020)
    draw = lambda n: [words[i] for i in rng.choice(6000, n, p=weight / weight.sum())]
    items = [draw(n) for n in rng.integers(15, 60, 1000)]
    place = {w: i for i, w in enumerate(words)}
    rows, want = [], set()
    for d in range(100):
        copy, edited = draw(60), draw(60)
        for k in range(10 * d, 10 * d + 10):
            copy += items[k] + draw(60)
            n = len(items[k])
            change = set(sorted(range(3 * n // 4), key=lambda p: -place[items[k][p]])[: n // 4])
            edited += [w + "zz" if p in change else w for p, w in enumerate(items[k])] + draw(60)
            want |= {(d, k), (100 + d, k)}
        rows += [(d, " ".join(copy)), (100 + d, " ".join(edited))]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == want


def test_the_basis_is_that_of_all_documents(spark):
    """Of 9,000 documents none is left out: the directions are the leading ones of the whole passage matrix."""
    rng = np.random.default_rng(8)
    weight = 1 / np.arange(1, 41)
    draw = lambda n, shift: [VOCAB[shift + i] for i in rng.choice(40, n, p=weight / weight.sum())]
    # Every third document draws from other words than the rest, so a part of them would give other directions.
    texts = [draw(int(rng.integers(1, 90)), 40 if d % 3 == 0 else 0) for d in range(9000)]
    slots = decontaminate._slot_table(spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], DOCS))
    of = lambda t: decontaminate._slots(decontaminate.words_of(" ".join(t).encode()))
    idf = decontaminate._idf(slots)
    seen = {k: sum(k in s for s in [set(of(t).tolist()) for t in texts]) for k in (int(of([w])[0]) for w in VOCAB[:5])}
    assert all(np.isclose(idf[k], np.log(9001 / (n + 0.5))) for k, n in seen.items())
    own = [decontaminate._passage(of(VOCAB[:80]), idf)]
    used = own[0][0]
    place = np.full(decontaminate.VOCABULARY + 1, len(used), np.int32)
    place[used] = np.arange(len(used))
    gram = np.zeros((len(used), len(used)))
    for t in texts:
        for a in range(0, len(t), decontaminate.PASSAGE):
            s, x = decontaminate._passage(of(t)[a : a + decontaminate.PASSAGE], idf)
            gram[np.ix_(place[s], place[s])] += np.outer(x, x)
    probe = np.linalg.qr(np.random.default_rng(5).normal(size=(len(used), 80)))[0]
    item = np.outer(own[0][1], own[0][1])[np.argsort(place[used])]
    whole = gram / np.abs(gram @ probe).max() + item / np.abs(item @ probe).max()
    basis = decontaminate._basis(slots, own, place, idf)
    values, vectors = np.linalg.eigh(whole)
    lead = vectors[:, ::-1][:, : decontaminate.RANK]
    assert basis.shape == lead.shape
    assert np.trace(basis.T @ whole @ basis) >= 0.999 * values[::-1][: decontaminate.RANK].sum()
    first = vectors[:, ::-1][:, :8]
    assert np.linalg.svd(first.T @ basis)[1].min() > 0.999
