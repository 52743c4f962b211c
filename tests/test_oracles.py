"""Every registered query against its DuckDB statement."""

import pytest

import __spark_entry__ as entry
from conftest import SF_TINY
from registry.compare import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# These match nothing in the smallest tables; at larger scales they do.
SPARSE = {"scan_documents", "scan_pages", "K17_rate_violations"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_TINY)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, name):
    found = compare(spark, con, QUERIES[name], ORACLES[name], SF_TINY)
    assert found is None or (found == "no rows" and name in SPARSE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
