"""Mixing sources to target weights: hierarchical token budgets and seeded token-prefixes.

Documents hang in a tree domain -> language -> source.  ``budgets`` hands a total of tokens
down the tree by weight.  A node can take at most ``max_epochs`` times its supply; what a
child can't take goes to its siblings by their weights, and only what all siblings together
can't take reaches the level above, because a subtree's capacity already caps what its
parent is given.  Siblings fill up in the order of capacity over weight, so a running sum over them finds who is
full: the tree may have any number of leaves and none are gathered on the driver.  ``select`` then takes, from each leaf, whole epochs and the token-prefix of
one more: documents in the order of a seeded hash of that epoch, as long as their running
token count stays within the leaf's budget.

The running count needs no sorted leaf: tokens are summed by leaf and by one of ``BUCKETS``
ranges of the hash, the range where the budget ends is found from these sums, and only
that range's rows are ordered (a few thousandths of a leaf), so a leaf with a third of all rows
is no different.

Null domain, language or source count as the empty name; null text has no tokens and comes
with any epoch in which its place is within the prefix; equal hashes are ordered by id, tokens and text;
repeated rows count as separate documents; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_text, save

BUCKETS = 4096
LEVELS = ("domain", "lang", "source")
#: Leaves whose budgets and ends are broadcast; more are joined.
SENT = 100_000


@dataclass(frozen=True)
class Plan:
    """domains: (name, pattern of source) in order; weights by level and name, others get
    ``default``; total: tokens wanted, or a share of the supply if at most ``share``."""

    domains: tuple[tuple[str, str], ...] = (("web", "[0-4]$"), ("books", "[5-7]$"), ("code", "[89]$"), ("other", ""))
    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {"domain": {"web": 0.5, "books": 0.3, "code": 0.15, "other": 0.05}, "lang": {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}})
    default: float = 0.1
    share: float = 1.0
    total: int | None = None
    max_epochs: int = 4
    seed: int = 11


def domain_of(plan: Plan, source: Column) -> Column:
    out = F.lit("")
    for name, pattern in reversed(plan.domains):
        out = F.when(source.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def leaves_of(documents: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens (white-space separated words), tie (hash of the text)."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return documents.select("doc_id", domain_of(plan, source).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), source.alias("source"), F.regexp_count(clean_text(), F.lit(r"\S+")).cast("long").alias("n_tokens"), F.xxhash64(clean_text()).alias("tie"))


def budgets(supply: DataFrame, plan: Plan) -> DataFrame:
    """supply(domain, lang, source, t) of the leaves -> the same with leaf_budget in tokens."""
    total = F.lit(float(plan.total)) if plan.total is not None else F.lit(plan.share) * F.col("supply")
    whole = supply.agg(F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("supply"))
    given = whole.select(F.least(total, F.col("supply") * plan.max_epochs).alias("given"))
    above: list[str] = []
    for level in LEVELS:
        key = [*above, level]
        weight = F.lit(plan.default)
        for name, w in plan.weights.get(level, {}).items():
            weight = F.when(F.col(level) == name, F.lit(w)).otherwise(weight)
        nodes = supply.groupBy(*key).agg((F.sum("t") * plan.max_epochs).cast("double").alias("capacity")).withColumn("weight", weight.cast("double"))
        nodes = nodes.join(given, above) if above else nodes.crossJoin(F.broadcast(given))  # one row
        # By capacity over weight, a sibling is full as long as what those before it left would give it as much.
        order = Window.partitionBy(*(above or [F.lit(0)])).orderBy(F.try_divide("capacity", "weight").asc_nulls_last(), level).rowsBetween(Window.unboundedPreceding, -1)
        rest = Window.partitionBy(*(above or [F.lit(0)])).orderBy(F.try_divide("capacity", "weight").asc_nulls_last(), level).rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("budget", F.greatest(F.col("given") - F.coalesce(F.sum("capacity").over(order), F.lit(0.0)), F.lit(0.0))).withColumn("weights", F.sum("weight").over(rest))
        share = F.coalesce(F.try_divide(F.col("budget") * F.col("weight"), F.col("weights")), F.lit(0.0))
        nodes = nodes.withColumn("full", F.col("capacity") <= share)
        # The first that is not full says what a unit of weight gets; those from it on share it.
        first = Window.partitionBy(*(above or [F.lit(0)]))
        unit = F.min_by(F.coalesce(F.try_divide("budget", "weights"), F.lit(0.0)), F.when(~F.col("full"), F.struct(F.coalesce(F.try_divide("capacity", "weight"), F.lit(float("inf"))), F.col(level)))).over(first)
        given = save(nodes.withColumn("unit", unit).select(*key, F.when(F.col("full"), F.col("capacity")).otherwise(F.col("unit") * F.col("weight")).alias("given")), "mix-given")
        above = key
    return supply.join(given, [*LEVELS]).withColumn("leaf_budget", F.floor(F.col("given") + 1e-6)).drop("given")


def _order(plan: Plan, epoch: Column) -> Column:
    return F.xxhash64(F.lit(plan.seed), epoch, F.col("doc_id"))


def select(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008  frozen
    """doc_id, epoch, domain, lang, source, n_tokens, leaf_budget: one row a chosen document and epoch."""
    rows = save(leaves_of(documents, plan), "mix-leaves")
    supply = save(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("t")), "mix-supply")
    whole = F.when(F.col("t") > 0, F.expr("leaf_budget div t")).otherwise(F.col("leaf_budget"))
    known = budgets(supply, plan).select(*LEVELS, "leaf_budget", whole.alias("whole"), F.when(F.col("t") > 0, F.col("leaf_budget") % F.col("t")).otherwise(0).alias("rest"))
    few = supply.count() <= SENT
    if few:
        known = F.broadcast(known)
    placed = rows.join(known, [*LEVELS]).withColumn("h", _order(plan, F.col("whole"))).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    sums = placed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest")))
    ends = ends.select(*LEVELS, F.col("bucket").alias("end"), "before")  # a row a leaf
    if few:
        ends = F.broadcast(ends)
    last = placed.join(ends, [*LEVELS], "left")
    inside = last.where(F.col("end").isNull() | (F.col("bucket") < F.col("end"))).where(F.col("rest") > 0)
    edge = last.where(F.col("bucket") == F.col("end"))
    run = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("h", "doc_id", "n_tokens", "tie").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("run", run).where((F.col("run") <= F.col("rest")) & (F.col("rest") > 0))
    out = ["doc_id", F.col("whole").cast("int").alias("epoch"), *LEVELS, "n_tokens", "leaf_budget"]
    full = placed.where(F.col("whole") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("epoch"), *LEVELS, "n_tokens", "leaf_budget")
    return full.unionByName(inside.select(*out)).unionByName(edge.select(*out))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return select(spark.read.parquet(f"{sf_dir}/documents.parquet"))
