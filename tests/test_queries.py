import pytest

from quillon.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_nothing_is_gathered(spark):
    """All changed features come without a sort and limit; a label's features are not collected before three examples are chosen."""
    diff = QUERIES["f17_diff"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in diff and "Sort [" not in diff
    relations = QUERIES["f16_show_relations"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(i" in relations and "collect_list(struct(layer" not in relations
