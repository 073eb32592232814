"""Quality scores: the model's parts against plain ones, held-out accuracy, unusual rows."""

import zlib

import numpy as np

from flowscape.llm import quality

SCHEMA = "doc_id long, text string"
RNG = np.random.default_rng(3)
VOCAB = ["".join(chr(97 + c) for c in RNG.integers(0, 26, RNG.integers(3, 9))) for _ in range(300)]


def _good(k):
    words = [VOCAB[i] for i in np.random.default_rng(k).integers(0, 300, 60 + k % 40)]
    return " ".join(w.capitalize() + "." if i % 8 == 7 else w for i, w in enumerate(words))


def _bad(k):
    return " ".join(w.upper() + "!!$$" if k % 2 else w[:1] * 9 for w in _good(k).split())


def _rows():
    return [(k, _good(k) if k % 3 else _bad(k)) for k in range(240)]


def test_isotonic_fit():
    assert quality.pool_adjacent(np.array([3.0, 1.0, 2.0]), np.ones(3)).tolist() == [2.0, 2.0, 2.0]
    rng = np.random.default_rng(1)
    for _ in range(20):
        v, w = rng.normal(size=8), rng.uniform(0.5, 2, 8)
        got = quality.pool_adjacent(v, w)
        # The min-max formula of isotonic regression.
        mean = lambda a, b: (v[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, 8)) for a in range(i + 1)) for i in range(8)]
        assert np.allclose(got, want)


def test_fit_equals_one_ridge_system(spark):
    """Weights from summed partitions are those of all rows at once."""
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(5)
    stats = quality.document_stats(df)
    known = spark.createDataFrame([(k, int(k % 3 > 0), k % 4 == 0) for k in range(240)], "key long, label int, calibrate boolean")
    model = quality.fit(stats, known)
    rows = {r.key: np.array(r.stats) for r in stats.collect()}
    every = np.stack([rows[k] for k in range(240)])
    assert np.allclose(model.mean, every.mean(axis=0)) and np.allclose(model.scale, np.maximum(every.std(axis=0), 1e-6))
    train = [k for k in range(240) if k % 4]
    x, y = model.features(every[train]), np.array([k % 3 > 0 for k in train], float)
    n = len(quality.STATS)
    ridge = 1e-3 * len(train) * np.diag([1e-9, *[0.01] * n, *[1.0] * 96])
    assert np.allclose(x.T @ x @ model.weights + ridge @ model.weights, x.T @ y, atol=1e-6 * len(train))
    levels = model.calibrated(every)
    assert ((levels >= 0) & (levels <= 1)).all()


def test_fourier_features_approximate_a_gaussian_kernel(spark):
    rng = np.random.default_rng(2)
    n, width, gamma = 6, 4000, 0.15
    model = quality.Model(np.zeros(n), np.ones(n), rng.normal(0, np.sqrt(2 * gamma / n * 4), (n, width)), rng.uniform(0, 2 * np.pi, width), np.zeros(1), np.zeros(1), np.zeros(1))
    z = rng.normal(size=(20, n))
    wave = model.features(z)[:, 1 + n :]
    want = np.exp(-gamma / n * 4 * ((z[:, None] - z[None]) ** 2).sum(axis=2))
    assert np.abs(wave @ wave.T - want).max() < 0.1


def test_held_out_accuracy_and_folds(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    labels = [(k, int(k % 3 > 0)) for k in range(240)]
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 5 == 0]
    got = {r.doc_id: r.score for r in quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert np.mean([(got[k] >= quality.THRESHOLD) == (k % 3 > 0) for k in held]) >= 0.95
    # The held-out labels teach nothing: turned round, they change no score.
    turned = [(k, 1 - q if k in held else q) for k, q in labels]
    again = {r.doc_id: r.score for r in quality.classify(df, spark.createDataFrame(turned, "doc_id long, quality int")).collect()}
    assert again == got


def test_unusual_rows(spark):
    rows = [(1, None), (2, ""), (None, "text"), (3, "\n"), (4, "word " * 200_000), (4, "again"), (5, _good(1)), (5, _good(1))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0.5 as score", "'s' as stats", "1 as label")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    scores = quality.classify(df, labels).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    none = quality.classify(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(df.limit(0), labels).count() == 0
