"""Each stage against a plain computation on what its predecessor kept."""

from collections import Counter

import numpy as np
import pytest

from flowscape.llm import pipeline, quality

COLUMNS = list(pipeline.COLUMNS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, label int"
RNG = np.random.default_rng(3)
VOCAB = ["".join(chr(97 + c) for c in RNG.integers(0, 26, RNG.integers(3, 9))) for _ in range(400)]


def _text(n, seed):
    words = [VOCAB[i] for i in np.random.default_rng(seed).integers(0, 400, n)]
    return " ".join(w.capitalize() + "." if i % 9 == 0 else w for i, w in enumerate(words))


def _junk(seed):
    return " ".join(f"{w.upper()}!!!" for w in _text(60, seed).split())


def _rows():
    long = _text(150, 1)
    rows = [(k, _text(80 + k % 50, 100 + k)) for k in range(60)] + [(100 + k, _junk(300 + k)) for k in range(60)]
    rows += [(200, long), (201, long), (None, long), (202, long.replace(" ", " x ", 2)), (None, _text(90, 5)), (None, _text(90, 5)), (203, _text(70, 6)), (203, _text(70, 7)), (204, None), (205, ""), (None, _junk(999))]
    rows += [(206, "intro words here " + LEAK + " and an end"), (None, LEAK + " tail"), (207, "key password = hunter2hunter2 " + _text(60, 8))]
    return [(i, t, "en" if (i or 0) % 2 else "de", f"src{(i or 0) % 10}", len(t or ""), 1, 2) for i, t in rows]


LEAK = _text(40, 50)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], 1 if r[0] < 100 else 0) for r in _rows() if r[0] is not None and r[0] < 160]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def _count(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = _count(docs)

    good = pipeline.quality_stage(spark, docs, folder)
    assert good.columns == COLUMNS
    scored = quality.classify(docs.where("doc_id is not null").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")).where("score < 0.3")
    poor = {r.doc_id for r in scored.collect()}
    kept = _count(good)
    assert not kept - every
    assert {k[0] for k in every if k[0] is not None} - {k[0] for k in kept} == poor
    assert poor >= {k for k in range(160) if k >= 100} and not poor & set(range(60))
    assert all("!!!" not in (k[1] or "") for k in kept)  # also the row without an id

    one = pipeline.near_duplicate_stage(spark, good, folder)
    unique = _count(one)
    assert max(unique.values()) == 1 and not unique - kept
    long = _text(150, 1)
    assert [k[0] for k in unique if k[1] and k[1].split() and k[1].replace(" x ", " ") == long] == [200]
    assert sum(k[1] == _text(90, 5) for k in unique) == 1  # both rows lack an id, one stays
    assert sum(k[0] == 203 for k in unique) == 2  # one id, two texts

    clean = pipeline.leak_stage(spark, one, folder)
    left = _count(clean)
    assert unique - left == Counter(k for k in unique if k[1] and LEAK in k[1])

    safe = pipeline.secret_stage(spark, clean, folder)
    after = _count(safe)
    assert sum(after.values()) == sum(left.values())
    assert {k[0] for k in after if k[1] and "[REDACTED]" in k[1]} == {207}
    assert all(k[4] == (None if k[1] is None else len(k[1])) for k in after)

    mixed = pipeline.mixing_stage(spark, safe, folder)
    assert {r.doc_id for r in mixed.collect()} <= {k[0] for k in after}
    assert pipeline.run(spark, folder).count() == mixed.count() > 0


def test_empty_tables(spark, folder, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
