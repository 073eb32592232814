"""Saved runs: strict tables, manifests written last, loaders that check them, count caches, chunks.

A run is a folder with one Parquet table a name and ``manifest.json``.  Everything goes through Spark's
file systems, so a folder may lie in any store Spark knows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


class RunError(ValueError):
    """A saved run that can't be trusted."""


# Files.


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    files, where = _files(spark, old)
    if not files.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise RunError(f"{new} can't be written")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The whole text or nothing: written beside the path, then renamed."""
    staged = f"{path}.{uuid.uuid4().hex}"
    files, where = _files(spark, staged)
    out = files.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
    if exists(spark, path):
        remove(spark, path)
    rename(spark, staged, path)


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _files(spark, path)
    if not files.exists(where):
        raise RunError(f"{path} is missing")
    return spark.read.text(path, wholetext=True).first()[0]


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n")


# Strict values and tables.


def _or_fail(ok: Column, value: Column, what: str, source: Column) -> Column:
    fault = F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(source.cast("string"), F.lit("null"))))
    return F.when(ok, value).otherwise(fault.cast("boolean") if what.endswith("boolean") else fault.cast("long"))


def boolean(text: Column) -> Column:
    """true, false, 1 or 0 in any case; anything else is an error."""
    low = F.lower(text)
    return _or_fail(F.coalesce(low.isin("true", "false", "1", "0"), F.lit(False)), low.isin("true", "1"), "not a boolean", text)


def integer(text: Column, least: int = 0, most: int = 2**63 - 1) -> Column:
    """Decimal digits within bounds; anything else is an error."""
    value = F.when(text.rlike("^-?[0-9]{1,19}$"), text.cast("decimal(19,0)"))
    return _or_fail(F.coalesce(value.between(least, most), F.lit(False)), value.cast("long"), "not an integer in range", text)


def read_csv(spark: SparkSession, path: str, columns: list[str], rows: int | None = None) -> DataFrame:
    """A CSV whose header is exactly these columns, all as text; ragged rows fail, and so does a wrong row count."""
    header = spark.read.text(path).first()
    if not header or header[0].split(",") != columns:
        raise RunError(f"{path}: unexpected columns {header and header[0]}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    if rows is not None and (found := df.count()) != rows:
        raise RunError(f"{path}: {found} rows, manifest says {rows}")
    return df


def write_table(df: DataFrame, path: str) -> None:
    """A Parquet table that appears whole; an old one is an error."""
    spark = df.sparkSession
    if exists(spark, path):
        raise RunError(f"{path} exists")
    staged = f"{path}._staging-{uuid.uuid4().hex}"
    try:
        df.write.parquet(staged)
        rename(spark, staged, path)
    except BaseException:
        remove(spark, staged)
        raise


def write_frequencies(counts: DataFrame, path: str) -> None:
    """counts(distribution, packet_count, frequency) as CSV in that order; range-sorted, not in one task."""
    ordered = counts.select("distribution", "packet_count", "frequency").orderBy("distribution", "packet_count")
    ordered.write.mode("errorifexists").csv(path, header=True)


# Runs.


@dataclass(frozen=True)
class Run:
    """A published run: its manifest and its tables, which are read when asked for."""

    spark: SparkSession
    folder: str
    manifest: dict

    def table(self, name: str) -> DataFrame:
        if name not in self.manifest["tables"]:
            raise RunError(f"{self.folder}: no table {name}")
        df = self.spark.read.parquet(f"{self.folder}/{name}")
        want = self.manifest["tables"][name]["columns"]
        if df.columns != want:
            raise RunError(f"{name}: columns {df.columns}, manifest says {want}")
        return df


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], facts: dict) -> Run:
    """Write the tables to a staging folder and the manifest last, then rename; a fault leaves nothing."""
    if exists(spark, folder):
        raise RunError(f"{folder} exists")
    staged = f"{folder.rstrip('/')}._staging-{uuid.uuid4().hex}"
    try:
        told = {}
        for name, df in tables.items():
            df.write.parquet(f"{staged}/{name}")
            told[name] = {"columns": df.columns, "rows": spark.read.parquet(f"{staged}/{name}").count()}
        write_json(spark, f"{staged}/{MANIFEST}", {**facts, "status": "success", "tables": told})
        rename(spark, staged, folder)
    except BaseException:
        remove(spark, staged)
        raise
    return load_run(spark, folder)


def load_run(spark: SparkSession, folder: str) -> Run:
    """A run by its manifest alone; it must have ended well."""
    manifest = json.loads(read_text(spark, f"{folder}/{MANIFEST}"))
    if manifest.get("status") != "success":
        raise RunError(f"{folder}: status {manifest.get('status')}")
    return Run(spark, folder, manifest)


def inspect(run: Run, config_hash: str | None = None) -> dict[str, int]:
    """Rows of each table, held against the manifest, and faults between tables: none, or an error."""
    if config_hash and run.manifest.get("config_hash") != config_hash:
        raise RunError("another configuration made this run")
    rows = {name: run.table(name).count() for name in run.manifest["tables"]}
    for name, n in rows.items():
        if n != run.manifest["tables"][name]["rows"]:
            raise RunError(f"{name}: {n} rows, manifest says {run.manifest['tables'][name]['rows']}")
    if {"flows", "labels"} <= set(rows):
        flows, labels = run.table("flows").select("flow_id"), run.table("labels").select("flow_id")
        if flows.join(labels, "flow_id", "left_anti").limit(1).count() or labels.join(flows, "flow_id", "left_anti").limit(1).count():
            raise RunError("flows and labels differ in their ids")
    return rows


def cached(spark: SparkSession, root: str, identity: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """A table kept under the fingerprint of what it was made from."""
    path = f"{root}/{fingerprint(identity)}"
    if not exists(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path)


# Batches, notes, chunks.


def dataset_ids(text: str) -> list[str]:
    """Ids in order, one a line, with # comments; an id twice or of another form is an error."""
    ids = [line.split("#")[0].strip() for line in text.splitlines()]
    ids = [i for i in ids if i]
    if len(set(ids)) != len(ids) or not all(re.fullmatch(r"\d{12}", i) for i in ids):
        raise RunError("dataset ids must be 12 digits and unique")
    return ids


def load_batch(spark: SparkSession, root: str, ids: list[str]) -> dict[str, Run]:
    """The runs of a batch that ended well, in order."""
    out = {}
    for i in ids:
        if exists(spark, f"{root}/{i}/{MANIFEST}"):
            out[i] = load_run(spark, f"{root}/{i}")
    return out


def together(runs: dict[str, Run], table: str) -> DataFrame:
    """One table of all runs, with the dataset's id."""
    out = None
    for i, run in runs.items():
        one = run.table(table).withColumn("dataset", F.lit(i))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise RunError("an empty batch")
    return out


NOTES = {"dataset", "run", "prefixes"}


def load_notes(text: str) -> dict:
    """Notes on a dataset, a run and its prefixes; other fields are an error."""
    notes = json.loads(text)
    if not isinstance(notes, dict) or set(notes) - NOTES:
        raise RunError("unknown note fields")
    return notes


def chunk_urls(day: str, template: str) -> list[tuple[str, str]]:
    """(chunk id, URL) of the 96 quarter hours of a day YYYYMMDD; the template has {chunk} once."""
    if not re.fullmatch(r"\d{8}", day) or template.count("{chunk}") != 1:
        raise RunError("a day of 8 digits and a template with one {chunk} are needed")
    ids = [f"{day}{h:02d}{m:02d}" for h in range(24) for m in (0, 15, 30, 45)]
    return [(i, template.replace("{chunk}", i)) for i in ids]


def write_chunk(observed: DataFrame, root: str, chunk: str) -> None:
    """The observations of one chunk, as the partition chunk_id of a table; done twice it is the same."""
    spark, path = observed.sparkSession, f"{root}/chunk_id={chunk}"
    if not exists(spark, path):
        write_table(observed, path)


def read_chunks(spark: SparkSession, root: str, chunks: list[str]) -> DataFrame:
    """Observations of these chunks; a missing one is an error.  Ports and flags must be in range."""
    for c in chunks:
        if not exists(spark, f"{root}/chunk_id={c}"):
            raise RunError(f"chunk {c} is missing")
    df = spark.read.option("basePath", root).parquet(*[f"{root}/chunk_id={c}" for c in chunks])
    bad = ~(F.col("src_port").between(0, 65535) & F.col("dst_port").between(0, 65535))
    if df.where(bad).limit(1).count():
        raise RunError("observations out of range")
    return df
