"""Tables that are built once a session and read by many queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where one machine runs all."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        if not getattr(spark, "_flowscape_tables", None):
            spark._flowscape_tables = "file://" + tempfile.mkdtemp(prefix="flowscape-")
        found = spark._flowscape_tables
    return found.rstrip("/")


_BUILT: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` over the input folder: written at its first use in this application, then read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: lineage ends here, and a join with it has two plain sides that can be split."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
