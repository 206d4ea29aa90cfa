"""Every registered query beside its check SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as contract
from netpulse import catalogue
from tools.check import compare, oracle_connection

QUERIES = catalogue.queries()
ORACLES = catalogue.oracles()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = df.toPandas()
    if name in ORACLES:
        assert compare(rows, oracle.sql(ORACLES[name]).df()) == "ok"
    else:
        assert len(rows)


def test_every_check_has_a_query():
    assert set(ORACLES) == set(QUERIES)


def test_contract_holds_the_catalogue():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_light_queries_read_few_columns(spark, sf_dir):
    plan = QUERIES["host_comparison"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double,props:string>" in plan
    plan = QUERIES["hourly_coverage"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_hot_groups_are_combined_before_the_shuffle(spark, sf_dir):
    """The first exchange of a roll-up is on the value too, after a partial count."""
    df = QUERIES["daily_rollup"](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "num" in lines[-1] and "txt" in lines[-1]
    assert "partial_count" in plan
    # The host counts are computed once and read again for ``all``.
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1
