"""Queries on events whose user ids are so many that address parts pass 255 and ports 65,535, as on large copies."""

import os

import duckdb
import pytest

from flowscape.operators import heavy
from flowscape.plans import more, registry

SF = "/root/testdata/sf0.001"
SHIFT = 88_500  # a copy's users: their third address part is 354 and more, their ports 128,500 and more
SAME = [
    "address_ports", "byte_summary", "condition_pivot", "condition_summary", "context_observations", "describe_bytes", "dominant_pattern", "duration_bins", "duration_profile",
    "ecdf_exact", "ecdf_sampled", "exclusive_contribution", "flow_flag_totals", "flow_jaccard", "heavy_conserved", "heavy_protocols", "heavy_residuals", "target_matches", "tuple_context",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """The small events and a copy with shifted keys."""
    made = tmp_path_factory.mktemp("wide")
    events = f"(SELECT * FROM '{SF}/events.parquet')"
    duckdb.connect().execute(f"COPY (SELECT event_id + 100000 * k AS event_id, ts, user_id + {SHIFT} * k AS user_id, event_type, value, props FROM {events}, range(2) t(k) ORDER BY event_id) TO '{made}/events.parquet' (FORMAT parquet)")
    return str(made)


def _rows(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", SAME)
def test_query_equals_oracle(spark, wide, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{wide}/events.parquet'")
    df = registry.queries()[name](spark, wide)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert _rows(df.collect(), df.columns) == _rows(cursor.fetchall(), names)


def test_two_stages_conserve_the_weights(spark, wide):
    found = more.heavy_two_stage(spark, wide)
    assert heavy.conserved(found, more._weights(spark, wide)).first().conserved
