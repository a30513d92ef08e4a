"""Every named query against its SQL on the smallest tables; those without SQL must run and give rows."""

import pytest

from peakfold.plans import catalog
from tests.conftest import SF

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = [tuple(r[i] for i in order) for r in got.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_plans_push_down_and_avoid_products(spark):
    """Filters and column lists reach the scan, and no query of the catalog compares all pairs."""
    plan = QUERIES["rt_slice"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan and "props" not in plan
    for name in ("range_join", "band_join", "anti_band", "nearest_asof_join", "similar_sequences", "substring_join"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
