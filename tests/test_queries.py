import pytest

from tests.oracle import check
from tidegrid.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_duckdb(spark, sf, name):
    check(spark, sf, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, sf):
    plan = registry.QUERIES["ref_f02_price_range"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(final_win)" in plan and "ReadSchema: struct<id:bigint,schedule_id:bigint,final_win:decimal(5,2)>" in plan
    joins = registry.QUERIES["ref_j12_similar_matches"](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in joins and "BroadcastNestedLoopJoin" not in joins
