"""All registered queries that have SQL against it, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

SF_DIR = os.environ.get("SECLOG_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    diff, _ = compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR)
    assert diff is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
