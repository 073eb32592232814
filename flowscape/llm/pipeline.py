"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
result as Parquet in the shared folder and reads it back as the next stage's documents.  All
but the last return the columns of documents, whatever else a table has.

A row is a document, told by the hash of its columns: a decision on a text is taken on the rows that hold it, so rows without
an id and several texts under one id are judged like any other.  Equal rows are judged alike; the second stage leaves one of
them.  Null and empty texts are scored, form one class, leak nothing and hold no secret; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, neardup, quality, secrets
from .common import save

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _told(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold go."""
    told = _told(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    stats = save(quality.document_stats(told, "_row"), "quality-stats")
    rows = told.select("doc_id", F.col("_row").alias("key")).where("doc_id is not null")
    fold = quality._fold("doc_id")
    known = rows.join(labels, "doc_id").where(fold != 0).select("key", "label", (fold == 4).alias("calibrate")).distinct()
    scores = quality.score(stats, quality.fit(stats, known))
    poor = scores.where(F.col("score") < quality.THRESHOLD).select(F.col("key").alias("_row")).distinct()
    return told.join(poor, "_row", "left_anti").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the least id."""
    return neardup.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    told = _told(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = decontaminate.leaks(told.select(F.col("_row").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_row")).distinct()
    return told.join(bad, "_row", "left_anti").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    done = secrets.redact(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chosen documents and epochs of the token budget."""
    return mixing.select(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", leak_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The classifier and the signatures can't be said in SQL; the tests hold the stages against plain computations.
ORACLE_SQL = None
