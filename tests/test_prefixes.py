"""Ledger cases: both versions, padding, containment."""

from flowscape.operators import distribution, prefixes


def test_ledger(spark):
    rows = [(" 10.0.0.0/24", "10.0.0.128/25"), ("10.0.0.7", "10.0.0.0/23"), ("2001:DB8::1/32", "2001:db8::/32"), ("*", None), ("10.0.0.9/24", "x"), ("::1", "10.9.9.9/33")]
    got = {r.prefix: r for r in prefixes.ledger(spark.createDataFrame(rows, "src_prefix string, dst_prefix string")).collect()}
    reasons = {p: (r.exclusion_reason, r.covered_by_prefix) for p, r in got.items()}
    assert reasons == {"10.0.0.0/24": (None, None), "10.0.0.128/25": ("covered_by_parent", "10.0.0.0/24"), "10.0.0.7/32": ("covered_by_parent", "10.0.0.0/24"), "10.0.0.0/23": ("broader_than_24", None), "2001:db8::/32": ("outside_ipv4_baseline", None), "::1/128": ("outside_ipv4_baseline", None)}
    assert (got["10.0.0.0/24"].src_count, got["2001:db8::/32"].src_count, got["2001:db8::/32"].dst_count) == (2, 1, 1)
    assert [p for p, r in got.items() if r.selected_for_analysis] == ["10.0.0.0/24"]


def test_histogram_grows_to_the_greatest(spark):
    df = spark.createDataFrame([("t", "raw", 1, 2), ("t", "raw", 3, 1), ("t", "raw", 3 << 20, 5)], "target string, condition string, packet_count long, n long")
    rows = sorted(distribution.histogram(df).collect(), key=lambda r: r.lo)
    assert [r.lo for r in rows] == [1, 2, 3, *[2**k for k in range(2, 22)]] and rows[-1].hi == 1 << 22
    assert {r.lo: r.n for r in rows if r.n} == {1: 2, 3: 1, 1 << 21: 5}
    assert distribution.axis_upper(999) == 1000
