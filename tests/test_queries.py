"""Each registered flow query against its SQL oracle at sf0.001."""

import os

import duckdb
import pytest

from flowscape.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
def _rows(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.collect(), df.columns) == _rows(cursor.fetchall(), names)
