"""Prefix ledger, containment, flow membership and heavy-hitter prefixes.

Containment and membership are equi-joins on (length, masked address): a prefix has at most nine
eligible lengths, so nothing is joined by range.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ip import cidr, ip4, network

LENGTHS = list(range(24, 33))


def parse(prefix):
    """CIDR text or bare address -> struct(net, len), null if it is not a concrete IPv4 network."""
    prefix = F.trim(prefix)
    ip, length = ip4(F.split_part(prefix, F.lit("/"), F.lit(1))), F.try_to_number(F.split_part(prefix, F.lit("/"), F.lit(2)), F.lit("99"))
    size = F.when(~F.contains(prefix, F.lit("/")), F.lit(32)).otherwise(length.cast("int"))
    return F.when(ip.isNotNull() & size.between(0, 32), F.struct(network(ip, size).alias("net"), size.alias("len")))


@F.pandas_udf(T.StructType([T.StructField("net", T.StringType()), T.StructField("len", T.IntegerType())]))
def parse6(prefix: pd.Series) -> pd.DataFrame:
    """IPv6 network text or address -> its one text and length, null for anything else."""

    def one(text):
        try:
            net = ipaddress.ip_network((text or "").strip(), strict=False)
        except ValueError:
            return None, None
        return (str(net), net.prefixlen) if net.version == 6 else (None, None)

    return pd.DataFrame([one(t) for t in prefix], columns=["net", "len"]).astype({"len": "Int32"})


def outside(candidates: DataFrame) -> DataFrame:
    """Ledger rows of the IPv6 prefixes: counted, never selected."""
    six = [candidates.select(F.col(c).alias("p"), F.lit(s).alias("s")).where(F.contains("p", F.lit(":"))) for c, s in (("src_prefix", 1), ("dst_prefix", 0))]
    rows = six[0].unionByName(six[1]).select(parse6("p").alias("p"), "s").where("p.net is not null")
    rows = rows.groupBy(F.col("p.net").alias("prefix"), F.col("p.len").alias("prefix_length")).agg(F.sum("s").alias("src_count"), F.count_if(F.col("s") == 0).alias("dst_count"), F.count(F.lit(1)).alias("total_count"))
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(None).cast("long").alias("net"), "prefix", "prefix_length", none.alias("normalized_prefix_24"), (F.col("src_count") > 0).alias("seen_as_src_prefix"), (F.col("dst_count") > 0).alias("seen_as_dst_prefix"),
        "src_count", "dst_count", "total_count", F.lit(False).alias("selected_for_analysis"), F.lit("outside_ipv4_baseline").alias("exclusion_reason"), none.alias("covered_by_prefix"),
    )


def ledger(candidates: DataFrame) -> DataFrame:
    """candidates(src_prefix, dst_prefix) -> one row a prefix with counts, eligibility, parent.  IPv6 prefixes
    have rows too, with their reason."""
    sides = candidates.select(parse(F.col("src_prefix")).alias("p"), F.lit(1).alias("s")).unionByName(candidates.select(parse(F.col("dst_prefix")).alias("p"), F.lit(0).alias("s")))
    rows = sides.where("p is not null").groupBy("p.net", "p.len").agg(F.sum("s").alias("src_count"), F.count_if(F.col("s") == 0).alias("dst_count"), F.count(F.lit(1)).alias("total_count"))
    rows = rows.withColumn("eligible", F.col("len") >= 24)
    up = rows.where("eligible").select("net", "len", F.explode(F.sequence(F.lit(24), F.col("len"))).alias("plen")).where("plen < len").withColumn("pnet", network(F.col("net"), F.col("plen")))
    parents = rows.where("eligible").select(F.col("net").alias("pnet"), F.col("len").alias("plen"))
    covered = up.join(parents, ["pnet", "plen"]).groupBy("net", "len").agg(F.min(F.struct("plen", "pnet")).alias("top"))
    out = rows.join(covered, ["net", "len"], "left")
    four = out.select(
        "net", cidr(F.col("net"), F.col("len")).alias("prefix"), F.col("len").alias("prefix_length"), F.when(F.col("eligible"), cidr(network(F.col("net"), F.lit(24)), F.lit(24))).alias("normalized_prefix_24"),
        (F.col("src_count") > 0).alias("seen_as_src_prefix"), (F.col("dst_count") > 0).alias("seen_as_dst_prefix"), "src_count", "dst_count", "total_count",
        (F.col("eligible") & F.col("top").isNull()).alias("selected_for_analysis"),
        F.when(~F.col("eligible"), "broader_than_24").when(F.col("top").isNotNull(), "covered_by_parent").alias("exclusion_reason"), F.when(F.col("top").isNotNull(), cidr(F.col("top.pnet"), F.col("top.plen"))).alias("covered_by_prefix"),
    )
    return four.unionByName(outside(candidates))


def membership(flows: DataFrame, prefixes: DataFrame, scope: str = "native") -> DataFrame:
    """flows(flow_id, src_n, dst_n) and ledger rows(net, prefix_length, prefix) ->
    (flow_id, analysis_scope, analysis_prefix, src_match, dst_match): src or dst inside."""
    p = prefixes.select("net", F.col("prefix_length").alias("len"), "prefix")
    if scope == "normalized_24":
        p = p.select(network(F.col("net"), F.lit(24)).alias("net"), F.lit(24).alias("len")).distinct().withColumn("prefix", cidr(F.col("net"), F.col("len")))
    lengths = F.explode(F.array(*[F.lit(n) for n in (LENGTHS if scope == "native" else [24])]))
    sides = F.explode(F.array(F.struct(F.col("src_n").alias("ip"), F.lit(1).alias("src")), F.struct(F.col("dst_n").alias("ip"), F.lit(0).alias("src"))))
    ends = flows.select("flow_id", sides.alias("e")).select("flow_id", "e.ip", "e.src", lengths.alias("len")).withColumn("net", network(F.col("ip"), F.col("len")))
    hits = ends.where("ip is not null").join(p, ["len", "net"])
    return hits.groupBy("flow_id", F.col("prefix").alias("analysis_prefix")).agg((F.max("src") == 1).alias("src_match"), (F.min("src") == 0).alias("dst_match")).withColumn("analysis_scope", F.lit(scope))


def heavy_prefixes(weights: DataFrame, percent: int, lengths: tuple[int, ...] = (32, 24, 16, 8)) -> DataFrame:
    """weights(ip4, w) -> residual heavy hitters of one dimension: at each length, from the
    longest up, groups whose remaining weight reaches ceil(total * percent / 100) are taken
    out; what is left is 0/0.  One aggregate a length, each on what the last one left."""
    total = weights.agg(F.sum("w").alias("total"))
    rest, found = weights.select(F.col("ip4").alias("net"), "w"), []
    for n in lengths:
        level = rest.groupBy(network(F.col("net"), F.lit(n)).alias("net")).agg(F.sum("w").alias("w")).crossJoin(F.broadcast(total))  # one row
        level = level.withColumn("hit", F.col("w") * 100 >= F.col("total") * percent)
        found.append(level.where("hit").select(cidr(F.col("net"), F.lit(n)).alias("prefix"), F.col("w").alias("residual")))
        rest = level.where("not hit").select("net", "w")
    out = rest.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("residual")).select(F.lit("0.0.0.0/0").alias("prefix"), "residual")
    for f in found:
        out = out.unionByName(f)
    return out


def legacy_score(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Average-rank percentiles of counts and one-minus-ratio terms, weighted."""
    out = features
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))  # a row a prefix
    score = F.lit(0.0)
    for name, w in weights.items():
        if name.endswith("_count"):
            ties = F.count(F.lit(1)).over(Window.partitionBy(name))
            score = score + w * (F.rank().over(Window.orderBy(name)) + (ties - 1) / 2) / n
        else:
            score = score + w * (1 - F.col(name))
    return out.withColumn("score", score)
