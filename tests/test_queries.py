import pytest
from oracle import check

from spanloom.plans.oracles import oracles
from spanloom.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_sql_gives(spark, sf_dir, name):
    check(spark, QUERIES[name], oracles()[name], sf_dir)


def test_every_query_has_sql():
    assert set(oracles()) == set(QUERIES)


def test_structured_scan_has_no_shuffle_and_no_python(spark, sf_dir):
    plan = QUERIES["span_suppressed"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
