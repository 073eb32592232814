"""Budgets against a plain hand-out, selection against a plain prefix, unusual rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowscape.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def _fill(budget, children):
    """By weight; what a full child can't take goes to the others."""
    out, rest = {}, list(children)
    while rest:
        weight = sum(w for _, w, _ in rest)
        full = [c for c in rest if c[2] <= (budget * c[1] / weight if weight else 0)]
        if not full:
            return out | {name: budget * w / weight if weight else 0.0 for name, w, _ in rest}
        for name, _, capacity in full:
            out[name] = capacity
            budget = max(budget - capacity, 0.0)
        rest = [c for c in rest if c[0] not in out]
    return out


def _plain(supply, plan):
    capacity = defaultdict(float)
    for leaf, tokens in supply.items():
        for depth in range(4):
            capacity[leaf[:depth]] += tokens * plan.max_epochs
    total = plan.total if plan.total is not None else plan.share * sum(supply.values())
    given = {(): min(total, capacity[()])}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in {leaf[:depth] for leaf in supply}:
            names = sorted({leaf[: depth + 1] for leaf in supply if leaf[:depth] == parent})
            given |= _fill(given[parent], [(n, plan.weights.get(level, {}).get(n[-1], plan.default), capacity[n]) for n in names])
    return {leaf: int(given[leaf] + 1e-6) for leaf in supply}


@pytest.mark.parametrize("seed", range(4))
def test_budgets_equal_a_plain_hand_out(spark, seed):
    rng = np.random.default_rng(seed)
    supply = {(str(rng.integers(3)), str(rng.integers(3)), f"s{k}"): int(rng.integers(0, 2000) * rng.integers(0, 4)) for k in range(14)}
    weights = {"domain": {"0": 0.7, "1": 0.3, "2": 0.0 if seed == 3 else 0.2}, "lang": {"0": 0.5}}
    for total, epochs in ((500, 1), (9000, 2), (10**6, 3)):
        plan = mixing.Plan(weights=weights, total=total, max_epochs=epochs)
        df = spark.createDataFrame([(*k, v) for k, v in supply.items()], "domain string, lang string, source string, t long")
        got = {(r.domain, r.lang, r.source): r.leaf_budget for r in mixing.budgets(df, plan).collect()}
        assert got == _plain(supply, plan)


def test_shortages_go_to_siblings_first(spark):
    df = spark.createDataFrame([("a", "x", "1", 100), ("a", "x", "2", 1000), ("b", "x", "1", 1000)], "domain string, lang string, source string, t long")
    plan = mixing.Plan(weights={}, total=1000, max_epochs=1)
    assert {(r.domain, r.lang, r.source): r.leaf_budget for r in mixing.budgets(df, plan).collect()} == {("a", "x", "1"): 100, ("a", "x", "2"): 400, ("b", "x", "1"): 500}


def _rows():
    rng = np.random.default_rng(5)
    rows = [(int(k), " ".join(["w"] * int(rng.integers(0, 30))), ["en", "de", None][k % 3], f"src{k % 7}") for k in range(150)]
    return rows + [(3, None, "en", None), (None, "a b c", "en", "src1"), (7, rows[7][1], *rows[7][2:]), (7, "other text", *rows[7][2:])]


@pytest.mark.parametrize("sent", [100_000, 0])
def test_selection_equals_a_plain_prefix(spark, monkeypatch, sent):
    monkeypatch.setattr(mixing, "SENT", sent)
    plan = mixing.Plan(share=0.8, max_epochs=3)
    df = spark.createDataFrame(_rows(), SCHEMA).selectExpr("*", "1 as tie", "2 as bucket", "3 as n_tokens", "'q' as domain")
    got = Counter((r.doc_id, r.epoch, r.domain, r.lang, r.source, r.n_tokens) for r in mixing.select(df, plan).collect())
    leaves = mixing.leaves_of(df, plan).withColumn("h0", mixing._order(plan, mixing.F.lit(0).cast("long"))).withColumn("h1", mixing._order(plan, mixing.F.lit(1).cast("long"))).withColumn("h2", mixing._order(plan, mixing.F.lit(2).cast("long"))).collect()
    supply = Counter()
    for r in leaves:
        supply[r.domain, r.lang, r.source] += r.n_tokens
        assert re.fullmatch("web|books|code|other", r.domain)
    want, budget = Counter(), _plain(dict(supply), plan)
    for leaf, tokens in supply.items():
        whole, rest = divmod(budget[leaf], tokens) if tokens else (0, 0)
        own = [r for r in leaves if (r.domain, r.lang, r.source) == leaf]
        for r in own:
            for epoch in range(whole):
                want[r.doc_id, epoch, *leaf, r.n_tokens] += 1
        run = 0
        for r in sorted(own, key=lambda r: (r[f"h{whole}"] % 2**64, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.tie)) if rest else []:
            run += r.n_tokens
            if run > rest:
                break
            want[r.doc_id, whole, *leaf, r.n_tokens] += 1
    assert sum(got.values()) > 50
    for leaf in supply:
        took = sum(k[5] * n for k, n in got.items() if k[2:5] == leaf)
        assert took <= budget[leaf]
    assert got == want
    assert any(0 < n < supply[leaf] for leaf, n in budget.items()) and any(n > supply[leaf] for leaf, n in budget.items())


def test_empty_table(spark):
    assert mixing.select(spark.createDataFrame([], SCHEMA)).count() == 0
