"""heavy_two_stage has no SQL: on ids past 63,999 it is held against a plain search, in dicts."""

import os
from collections import Counter

import duckdb
import pytest

from flowscape.plans import more
from flowscape.plans.catalog import IP
from flowscape.plans.surrogate import flows_sql

SF = "/root/testdata/sf0.001"
SHIFT = 88_500  # as in test_wide_ids

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def _plain(weights, percent):
    """Residuals by (net, length) of weights by address, a length at a time."""
    least, level, found = -(-sum(weights.values()) * percent // 100), Counter(weights), {}
    for length in range(32, 0, -1):
        up = Counter()
        for net, w in level.items():
            if w >= least:
                found[net, length] = w
            else:
                up[net - net % (1 << (33 - length))] += w
        level = up
    found[0, 0] = sum(level.values())
    return found


def test_two_stages_equal_a_plain_search(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id + 100000 * k AS event_id, ts, user_id + {SHIFT} * k AS user_id, event_type, value, props FROM '{SF}/events.parquet', range(2) t(k) ORDER BY event_id) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    rows = con.execute(f"WITH {flows_sql()} SELECT flow_id % 2, {IP.format('src_ip')}, sum(byte_count)::BIGINT FROM fl GROUP BY 1, 2").fetchall()
    first = Counter()
    for block in (0, 1):
        for (net, _), w in _plain({ip: w for b, ip, w in rows if b == block}, 2).items():
            first[net] += w
    want = {(".".join(str(net >> s & 255) for s in (24, 16, 8, 0)) + f"/{length}", w) for (net, length), w in _plain(first, 2).items()}
    found = [tuple(r) for r in more.heavy_two_stage(spark, str(tmp_path)).collect()]
    assert len(found) == len(want)
    assert set(found) == want
