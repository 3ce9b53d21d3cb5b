"""Every registered query at the smallest scale against its SQL."""

import duckdb
import pytest

from workload import ORACLES, QUERIES
from workload.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    _, rows, verdict = compare(spark, con, name, SF)
    assert verdict.startswith("ok" if name in ORACLES else "rows only"), verdict
    assert rows > 0 or name == "stalled_users"
