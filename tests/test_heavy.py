"""Heavy hitters at every prefix length, by hand."""

import pytest

from flowscape.functions.ip import ip4
from flowscape.operators import heavy
from pyspark.sql import functions as F


def _weights(spark, rows):
    return spark.createDataFrame(rows, "ip string, w long").select(ip4(F.col("ip")).alias("ip4"), "w")


def _found(df):
    return {r.prefix: r.residual for r in df.collect()}


def test_what_is_left_climbs_bit_by_bit(spark):
    rows = [("192.0.2.1", 80), ("192.0.2.2", 10), ("192.0.2.4", 10)]
    assert _found(heavy.residuals(_weights(spark, rows), 20)) == {"192.0.2.1/32": 80, "192.0.2.0/29": 20, "0.0.0.0/0": 0}


def test_the_wildcard_is_kept_below_the_threshold(spark):
    rows = [("10.0.0.1", 70), ("20.0.0.1", 25), ("200.0.0.1", 5)]
    found = heavy.residuals(_weights(spark, rows), 20)
    assert _found(found) == {"10.0.0.1/32": 70, "20.0.0.1/32": 25, "0.0.0.0/0": 5}
    assert heavy.conserved(found, _weights(spark, rows)).first().conserved


def test_threshold_is_rounded_up_and_bounded(spark):
    rows = [("10.0.0.1", 1), ("20.0.0.1", 100)]
    assert _found(heavy.residuals(_weights(spark, rows), 1)) == {"20.0.0.1/32": 100, "0.0.0.0/0": 1}  # ceil(1.01) = 2
    with pytest.raises(ValueError):
        heavy.residuals(_weights(spark, rows), 0)
