"""Heavy-hitter reports: numbered aggregates with indented protocol lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The report's line formats.
AGGREGATE = r"^\[\s*(\d+)\]\s+(\S+)\s+(\S+):\s+([\d,]+)\s+\((\d+(?:\.\d+)?)%\)\s+([\d,]+)\s+\((\d+(?:\.\d+)?)%\)\s*$"
ENTRY = r"\[(\d+|\*):([^:\]]+):([^\]]+)\]\s+(\d+(?:\.\d+)?)%\s+(\d+(?:\.\d+)?)%"
BREAKDOWN = rf"^{ENTRY}(?:\s+{ENTRY})*$"


def parse_report(lines: DataFrame, any_protocol: bool = False) -> DataFrame:
    """lines(file, line_no, line) -> one row an aggregate, as text but for the four protocol ratios.

    Lines that are blank or start with % are left out; any other that is no aggregate and no indented
    breakdown under one is an error.  ``any_protocol`` admits * as a protocol."""
    rows = lines.withColumn("s", F.regexp_replace("line", r"^\s+|\s+$", "")).where("s <> '' and not startswith(s, '%')")
    head = F.col("s").rlike(AGGREGATE)
    star = F.lit(any_protocol) | ~F.contains(F.col("s"), F.lit("[*:"))
    order = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("head", head).withColumn("record", F.sum(F.col("head").cast("int")).over(order))
    fine = F.col("head") | ((F.col("record") > 0) & F.col("line").rlike(r"^\s") & F.col("s").rlike(BREAKDOWN) & star)
    fault = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" is not understood: "), F.col("line"))).cast("boolean")
    rows = rows.where(F.when(fine, F.lit(True)).otherwise(fault))
    part = lambda i: F.regexp_extract("s", AGGREGATE, i)
    heads = rows.where("head").select("file", "record", *[part(i).alias(n) for i, n in ((1, "aggregate_id"), (2, "src_prefix"), (3, "dst_prefix"), (5, "byte_ratio"), (7, "packet_ratio"))], F.replace(part(4), F.lit(",")).alias("bytes"), F.replace(part(6), F.lit(",")).alias("packets"))
    below = rows.where("not head").groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), " ").alias("protocol_breakdown"))
    out = heads.join(below, ["file", "record"], "left").withColumn("protocol_breakdown", F.coalesce("protocol_breakdown", F.lit("")))

    def total(protocol: str, group: int):
        found = F.regexp_extract_all("protocol_breakdown", F.lit(ENTRY.replace(r"(\d+|\*)", f"({protocol})", 1)), F.lit(group))
        return F.aggregate(found, F.lit(0.0), lambda a, x: a + x.cast("double"))

    for protocol, name in (("6", "tcp"), ("17", "udp")):
        for group, kind in ((4, "byte"), (5, "packet")):
            out = out.withColumn(f"{name}_{kind}_ratio", F.format_string("%.2f", total(protocol, group)))
    return out.drop("record")


def read_report(spark, path: str, any_protocol: bool = False) -> DataFrame:
    """The report at a path; line numbers are taken from one read of the whole file."""
    whole = spark.read.text(path, wholetext=True).select(F.lit(path).alias("file"), F.split("value", "\n").alias("all"))
    return parse_report(whole.select("file", F.posexplode("all").alias("line_no", "line")), any_protocol)
