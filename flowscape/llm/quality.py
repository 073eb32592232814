"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

``document_stats`` reduces every whole text to a few numbers (length, character classes,
word shapes, repetition); language, source, ids and labels are never read.  ``fit`` joins
the training labels to those statistics, maps them through ``width`` random Fourier features
(cosines of random projections, which approximate a Gaussian kernel), sums the normal
equations of each partition and adds the sums by matrix row, solves the ridge system on the
driver (width x width, whatever the input), and fits isotonic calibration (pool adjacent
violators) on a part of the training rows kept out of the ridge fit, from counts in ``BINS``
bins of the raw score.  ``score`` applies the model to every row.

Null and empty texts get the statistics of the empty text and a score like any other; equal
texts get equal scores; labels that are null are left out of the fit; an id labelled twice
counts twice.  With no usable labels the score is 0.5 (with one class, its share).  Extra columns with clashing
names don't matter: only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, save, word_hashes

STATS = (
    "log_bytes", "log_words", "upper", "digit", "punct", "symbol", "space", "newline", "high", "bang",
    "pipe", "word_bytes", "word_sd", "distinct", "top_word", "short", "line_bytes", "dup_lines", "ends", "symbol_words",
)
BINS = 1024

_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"#$%&*@^~_=+<>{}[]\\/", b" \t\r\x0b\x0c", b"\n", bytes(range(128, 256)), b"!", b"|")):
    _KIND[list(_chars)] = _k + 1


def stats_of(data: bytes) -> np.ndarray:
    """The statistics of one text."""
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_KIND, np.bincount(raw, minlength=256), 10)
    n = max(1, len(raw))
    hashes, start, end = word_hashes(data, lower=False)
    words = max(1, len(start))
    lengths = end - start
    _, copies = np.unique(hashes, return_counts=True)
    lines = [x for x in data.split(b"\n") if x.strip()]
    last = raw[end - 1] if len(end) else raw[:0]
    return np.array(
        [
            np.log1p(len(raw)), np.log1p(len(start)), *(kinds[1:] / n),
            lengths.mean() if len(start) else 0, lengths.std() if len(start) else 0,
            len(copies) / words, copies.max(initial=0) / words, (lengths <= 3).sum() / words,
            np.log1p(len(raw) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
            np.isin(last, (46, 63)).sum() / words, np.isin(_KIND[last], (4, 8)).sum() / words,
        ]
    )


def document_stats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and stats (array<double>), one row a document, in one pass over the texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [stats_of(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in batch.column(1)]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "stats"])

    kind = dict(documents.dtypes)[key]
    return documents.select(F.col(key).alias("key"), clean_text(text).alias("text")).mapInArrow(measure, f"key {kind}, stats array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.project + self.phase) * np.sqrt(2 / self.project.shape[1])
        return np.hstack([np.ones((len(z), 1)), z, wave])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def calibrated(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.cuts, self.levels)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) weighted least squares fit."""
    stack: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        stack.append([v, w, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            v2, w2, n2 = stack.pop()
            v1, w1, n1 = stack.pop()
            stack.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in stack]) if stack else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, width: int = 96, gamma: float = 0.15, ridge: float = 1e-3, seed: int = 7) -> Model:
    """stats(key, stats) and labels(key, label 0/1, calibrate boolean) -> model."""
    n = len(STATS)
    rng = np.random.default_rng(seed)
    train = save(stats.join(labels.where(F.col("label").isNotNull()), "key").select("stats", F.col("label").cast("double").alias("label"), "calibrate"), "quality-train")
    cells = [F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(n)] + [F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(n)]
    row = train.agg(F.avg("label").alias("share"), *cells).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(n)])
    scale = np.array([max(row[f"s{i}"] or 0.0, 1e-6) for i in range(n)])
    blank = Model(mean, scale, rng.normal(0, np.sqrt(2 * gamma / n * 4), (n, width)), rng.uniform(0, 2 * np.pi, width), np.zeros(1 + n + width), np.zeros(1), np.full(1, 0.5 if row["share"] is None else row["share"]))
    if row["share"] in (None, 0.0, 1.0):
        return blank
    size = 1 + n + width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = blank.features(batch.column(0).flatten().to_numpy().reshape(-1, n))
            total += x.T @ np.hstack([x, batch.column(1).to_numpy()[:, None]])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * (size + 1), pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), lists], names=["i", "row"])

    # Each partition gives one small matrix; they are added by matrix row, not on the driver.
    parts = train.where(~F.col("calibrate")).select("stats", "label").mapInArrow(sums, "i int, row array<double>")
    added = parts.groupBy("i").agg(F.array(*[F.sum(F.get("row", F.lit(j))) for j in range(size + 1)]).alias("row")).collect()
    system = np.zeros((size, size + 1))
    for r in added:
        system[r.i] = r.row
    count = max(system[0, 0], 1.0)
    weights = np.linalg.solve(system[:, :size] + ridge * count * np.diag([1e-9, *[0.01] * n, *[1.0] * width]), system[:, size])
    model = Model(mean, scale, blank.project, blank.phase, weights, blank.cuts, blank.levels)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.raw(batch.column(0).flatten().to_numpy().reshape(-1, n))
            bins = np.clip(((s + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "label"])

    counted = train.where("calibrate").select("stats", "label").mapInArrow(raw, "bin long, label double").groupBy("bin").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n"), F.avg("bin").alias("at")).orderBy("bin").collect()
    if not counted:
        return Model(mean, scale, blank.project, blank.phase, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    ones, seen = (np.array([r[k] for r in counted], float) for k in ("ones", "n"))
    levels = pool_adjacent((ones + 1e-3) / (seen + 2e-3), seen)
    cuts = (np.array([r.bin for r in counted]) + 0.5) / BINS * 2 - 0.5
    return Model(mean, scale, blank.project, blank.phase, weights, cuts, levels)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """key and score (0 to 1) of every row."""
    n = len(STATS)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.calibrated(batch.column(1).flatten().to_numpy().reshape(-1, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["key", "score"])

    return stats.mapInArrow(apply, f"key {dict(stats.dtypes)['key']}, score double")


def _fold(key: str):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5))


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key and score of every document.  Labels of fold 0 are never learnt from; fold 4 calibrates."""
    stats = save(document_stats(documents, key, text), "quality-stats")
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label"), (_fold(key) == 4).alias("calibrate")).where(_fold("key") != 0)
    return score(stats, fit(stats, known)).withColumnRenamed("key", key)


THRESHOLD = 0.3


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = classify(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
