"""Hierarchical heavy hitters: residuals at every prefix length, protocols, two stages.

From the longest length up, a prefix whose remaining weight reaches ceil(total * percent / 100) is taken out with
that weight; what is left goes to its parent, and in the end to the wildcard 0/0.  Bits are taken eight
at a time: a group is one /24, /16, /8 or 0/0 with at most 256 entries and the prefixes they grow to, so no task holds an
unbounded group and the whole search costs four shuffles of what is left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ip import cidr, network


def _octet(rest: DataFrame, total: DataFrame, top: int, percent: int) -> DataFrame:
    """rest(net, w) of length top + 8 -> net, len, w, hit: residuals found, and what is left at ``top``."""
    size = 1 << (32 - top)

    def climb(block: pd.DataFrame) -> pd.DataFrame:
        least = -(-int(block["total"].iloc[0]) * percent // 100)
        base = int(block["parent"].iloc[0])
        level, out = dict(zip(block["net"].astype(int), block["w"].astype(int), strict=True)), []
        for length in range(top + 8, top, -1):
            step, up = 1 << (33 - length), {}
            for net, w in sorted(level.items()):
                if w >= least:
                    out.append((net, length, w, True))
                else:
                    parent = net - net % step
                    up[parent] = up.get(parent, 0) + w
            level = up
        out += [(base, top, w, False) for w in level.values() if w]
        return pd.DataFrame(out, columns=["net", "len", "w", "hit"]).astype({"net": "int64", "len": "int32", "w": "int64", "hit": bool})

    keyed = rest.withColumn("parent", F.col("net") - F.pmod("net", F.lit(size))).crossJoin(F.broadcast(total))  # one row
    return keyed.groupBy("parent").applyInPandas(climb, "net long, len int, w long, hit boolean")


def residuals(weights: DataFrame, percent: int, keep=lambda df, name: df) -> DataFrame:
    """weights(ip4, w) -> prefix, net, len, residual; they sum to the total, and 0.0.0.0/0 is kept even below the
    threshold.  ``keep`` may write a stage's table and read it back."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    total = weights.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("total"))
    rest, found = weights.groupBy(F.col("ip4").alias("net")).agg(F.sum("w").alias("w")), None
    for top in (24, 16, 8, 0):
        level = keep(_octet(rest, total, top, percent), f"heavy-{top}")
        hits = level.where("hit").select("net", "len", "w")
        found = hits if found is None else found.unionByName(hits)
        rest = level.where("not hit").groupBy("net").agg(F.sum("w").alias("w"))
    wild = rest.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).select(F.lit(0).cast("long").alias("net"), F.lit(0).alias("len"), "w")
    return found.unionByName(wild).select(cidr(F.col("net"), F.col("len")).alias("prefix"), "net", "len", F.col("w").alias("residual"))


def owners(weights: DataFrame, found: DataFrame) -> DataFrame:
    """weights(ip4, ...) with the longest prefix found that holds the address: an equi-join a length that is present."""
    lengths = sorted(r.len for r in found.select("len").distinct().collect())  # 33 at most
    by = F.explode(F.array(*map(F.lit, lengths)))
    keyed = weights.withColumn("len", by).withColumn("net", network(F.col("ip4"), F.col("len")))
    hits = keyed.join(found.select("net", "len", "prefix"), ["net", "len"])
    return hits.groupBy(*weights.columns).agg(F.max_by("prefix", "len").alias("prefix"))


def protocols(weights: DataFrame, found: DataFrame, percent: int, heuristics: int = 0) -> DataFrame:
    """weights(ip4, protocol, w) -> prefix, protocol, w of each residual whose protocol reaches the
    sub-attribute threshold: four times the address threshold's percentage of the residual, or the same if heuristics is 2."""
    share = percent if heuristics == 2 else min(100, 4 * percent)
    own = owners(weights, found).groupBy("prefix", "protocol").agg(F.sum("w").alias("w"))
    return own.join(found.select("prefix", "residual"), "prefix").where(F.col("w") * 100 >= F.col("residual") * share).select("prefix", "protocol", "w")


def two_stage(weights: DataFrame, percent: int, keep=lambda df, name: df) -> DataFrame:
    """weights(block, ip4, w): the search on each input block, then on the blocks' residuals together."""
    blocks = sorted(r.block for r in weights.select("block").distinct().collect())  # input blocks, a few
    first = None
    for b in blocks:
        one = residuals(weights.where(F.col("block") == b).select("ip4", "w"), percent, lambda df, name, b=b: keep(df, f"{name}-{b}")).select(F.col("net").alias("ip4"), F.col("residual").alias("w"))
        first = one if first is None else first.unionByName(one)
    return residuals(first, percent, keep)


def conserved(found: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: the sum of residuals, the sum of weights, and whether they agree."""
    one = found.agg(F.sum("residual").alias("residuals"))
    return one.crossJoin(F.broadcast(weights.agg(F.sum("w").alias("weights")))).withColumn("conserved", F.col("residuals") == F.col("weights"))  # one row each
