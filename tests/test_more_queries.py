import pytest

from quillon import scalar_queries, store_queries
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
QUERIES = {**store_queries.QUERIES, **scalar_queries.QUERIES}
ORACLE_SQL = {**store_queries.ORACLE_SQL, **scalar_queries.ORACLE_SQL}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
