"""The rules of packing and mixing, counted over the smallest tables, against their SQL."""

import pytest

from dimforge.llm import queries
from tests.compare import compare, connect


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rules_are_kept(spark, data, name):
    said, ok = compare(spark, connect(data), name, queries.queries()[name], queries.oracle_sql()[name], data)
    assert ok, said
