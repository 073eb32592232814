"""Helpers shared by the corpus operators: tables, the shared work folder, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling byte hash (arithmetic modulo 2**64), and its inverse.
ROLL = np.uint64(0x9E3779B97F4A7C15)
ROLL_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only if unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        # One machine runs everything: its own temporary folder is shared.
        if not getattr(spark, "_flowscape_dir", None):
            spark._flowscape_dir = "file://" + tempfile.mkdtemp(prefix="flowscape-")
        found = spark._flowscape_dir
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df once in the shared folder and read it back: lineage is cut and a lost
    executor costs only the tasks that reread the table."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    atexit.register(_forget, df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete a table written by save(), once nothing lazy reads it any more."""
    if path := getattr(df, "_saved_at", None):
        _forget(df.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder is scratch
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean_text(column: str = "text"):
    """The text column, null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROLL**i and ROLL**-i for i < n, grown as needed."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((ROLL, ROLL_INV)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _POWERS[k] = np.multiply.accumulate(grown)
    return _POWERS[0][:n], _POWERS[1][:n]


#: One random 64-bit value per byte, so that the rolling sums have no structure.
BYTES = mix(np.arange(1, 257, dtype=np.uint64))

#: Bytes of a text that are hashed at a time; the arrays of a step grow with this, not with the text.
PIECE = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = ~_SPACE
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _long_hash(raw: np.ndarray) -> np.uint64:
    """The rolling sum of one word longer than PIECE, piece by piece."""
    total, step = 0, pow(int(ROLL), PIECE, 2**64)
    shift = 1
    for a in range(0, len(raw), PIECE):
        part = raw[a : a + PIECE]
        total += shift * int((BYTES[part] * powers(PIECE)[0][: len(part)]).sum(dtype=np.uint64))
        shift = shift * step % 2**64
    return np.uint64(total % 2**64)


def run_hashes(data: bytes, member: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the longest runs of ``member`` bytes (folded by ``fold``) with start and
    end offsets.  A text of any length is read in pieces; a run may be longer than a piece."""
    every = np.frombuffer(data, np.uint8)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(every):
        stop = min(at + PIECE, len(every))
        if stop < len(every):
            # End behind the last gap of the piece, or else behind the run that fills it.
            gaps = np.flatnonzero(~member[every[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                while stop < len(every):
                    ahead = np.flatnonzero(~member[every[stop : stop + PIECE]])
                    if len(ahead):
                        stop += int(ahead[0])
                        break
                    stop = min(stop + PIECE, len(every))
        raw = every[at:stop]
        if len(raw) > PIECE:
            hashes.append(np.array([_long_hash(fold[raw])], np.uint64))
            starts.append(np.array([at]))
            ends.append(np.array([stop]))
        else:
            edge = np.flatnonzero(np.diff(np.concatenate(([False], member[raw], [False])).astype(np.int8)))
            a, b = edge[0::2], edge[1::2]
            if len(a):
                up, down = powers(PIECE + 1)
                total = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(BYTES[fold[raw]] * up[: len(raw)], out=total[1:])
                hashes.append((total[b] - total[a]) * down[a])
                starts.append(a + at)
                ends.append(b + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return mix(np.concatenate(hashes)), np.concatenate(starts), np.concatenate(ends)


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of UTF-8 bytes, with start and end offsets."""
    return run_hashes(data, _WORD, _LOWER if lower else _SAME)
