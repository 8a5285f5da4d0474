"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    problem = compare(spark, connection, SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns[:2] == ["id", "received_at"]
    assert frame.count() > 0
