"""Every registered query with SQL equals that SQL on the smallest tables."""

import pytest

import check_queries
from table_queries import load

FOLDER = "/root/testdata/sf0.001"
REGISTRY = load()


@pytest.fixture(scope="module")
def con():
    return check_queries.database(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, con, name):
    got = check_queries.compare(spark, con, FOLDER, name, REGISTRY.QUERIES[name], REGISTRY.SQL.get(name))
    assert got.startswith(("ok", "rows")), got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
