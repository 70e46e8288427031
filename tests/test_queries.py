"""Every registered query runs over the smallest tables and agrees with its SQL."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

NAMES = [n for n in entry.queries() if n not in getattr(entry.texts, "queries", dict)()]


@pytest.fixture(scope="module")
def con(data):
    pytest.importorskip("duckdb")
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, data, name):
    said, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), data)
    assert ok, said


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
