"""Every registered query of the engine against its DuckDB SQL, or run where it has none."""

import pytest

from support import SF, same_as_sql
from lodequery.plans import registry

ORACLES = registry.oracles()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    if name in ORACLES:
        same_as_sql(duck, df, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_knn_is_a_top_k_plan(spark):
    plan = registry.queries()["knn_cosine"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_filters_reach_the_scan(spark):
    plan = registry.queries()["filter_eq"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_kmeans_recall(spark):
    assert registry.queries()["ivf_kmeans_recall"](spark, SF).first()["recall"] >= 0.9
    assert registry.queries()["lsh_recall"](spark, SF).first()["recall"] >= 0.9
