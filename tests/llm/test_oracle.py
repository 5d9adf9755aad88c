"""The corpus queries that SQL can express, and rows in the order of their tables for the others."""

import pytest

from volpanel.llm import queries

from ..oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
