import pytest

from volpanel.plans import catalog

from .oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
