import pytest

from lexiform.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, agrees, name):
    assert agrees(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_adjusted_scores_of_the_whole_window(spark):
    assert QUERIES["adjusted_scores"](spark, SF).groupBy("qid").count().where("count > 50").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
