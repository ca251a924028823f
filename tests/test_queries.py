"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
import check
from cinderlog.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, con, name):
    _, verdict = check.compare(
        spark, con, SF, name, contract.queries()[name], contract.oracle_sql().get(name)
    )
    assert verdict.startswith("ok") and "types" not in verdict


def test_entry(spark):
    assert contract.entry(spark).count() == 1
