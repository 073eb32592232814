"""Structured Streaming over packet rows.

A packet's event time is ``ts`` in seconds.  Rows later than the watermark are dropped here, which the batch
operators never do; over the same rows with a wide enough watermark both give the same windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flows import KEY, with_key
from ..sources import runs

PACKETS = "packet_index long, ts double, protocol int, src_ip string, src_port int, dst_ip string, dst_port int, flags int, payload_bytes long, frame_bytes long"


def read_packets(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files of packets that appear in a folder."""
    return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def timed(packets: DataFrame, late: str) -> DataFrame:
    return packets.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)


def slots(packets: DataFrame, size: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Packets and bytes of each slot."""
    return timed(packets, late).groupBy(F.window("at", size).alias("slot")).agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_bytes").alias("bytes")).select("slot.start", "slot.end", "packets", "bytes")


def syn_windows(packets: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    """Plain SYNs of each sender in sliding windows, with about how many targets (exact counts need the batch path)."""
    plain = (F.col("protocol") == 6) & (F.col("flags").bitwiseAND(2) != 0) & (F.col("flags").bitwiseAND(16) == 0)
    rows = timed(packets.where(plain), late).groupBy(F.window("at", size, step).alias("w"), "src_ip")
    return rows.agg(F.count(F.lit(1)).alias("syns"), F.approx_count_distinct(F.struct("dst_ip", "dst_port")).alias("targets")).select("w.start", "w.end", "src_ip", "syns", "targets")


def session_flows(packets: DataFrame, timeout: str, late: str = "1 hour") -> DataFrame:
    """Conversations by 5-tuple, ended by silence over the timeout in event time."""
    rows = timed(with_key(packets), late).groupBy(*KEY, F.session_window("at", timeout).alias("s"))
    flows = rows.agg(F.count(F.lit(1)).alias("packet_count"), F.sum("frame_bytes").alias("byte_count"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return flows.select(*KEY, "packet_count", "byte_count", "start_time", "end_time")


def ingest(packets: DataFrame, root: str, checkpoint: str):
    """Write the stream's packets as chunks of a quarter hour, once each batch whatever fails between: a batch's rows of a
    chunk are a folder of their own, named by the batch, that a second try finds and leaves alone."""

    def put(batch: DataFrame, number: int) -> None:
        slot = F.date_format(F.timestamp_seconds(F.floor(F.col("ts") / 900) * 900), "yyyyMMddHHmm")
        target = f"{root}/batch={number}"
        if not runs.exists(batch.sparkSession, target):
            staged = f"{root}/_staging-{number}"
            batch.withColumn("chunk_id", slot).write.mode("overwrite").partitionBy("chunk_id").parquet(staged)
            runs.rename(batch.sparkSession, staged, target)

    return packets.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retire(spark: SparkSession, root: str, raw: list[str], expected: dict[int, int]) -> list[str]:
    """Delete raw files once the batches that hold them are there with the rows expected; returns what went."""
    for number, rows in expected.items():
        if not runs.exists(spark, f"{root}/batch={number}") or spark.read.parquet(f"{root}/batch={number}").count() != rows:
            raise runs.RunError(f"batch {number} is not complete")
    for path in raw:
        runs.remove(spark, path)
    return raw
