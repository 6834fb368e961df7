"""A spread of the catalog against DuckDB; tools/check.py runs all of it."""

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = ["events", "orders", "documents"]
SPREAD = ["src5_weather_json", "j2_bounded_nearest_join", "j5_station_fallback", "k1_ranked_alerts", "x3_next_step", "a12_class_weights"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def fetch(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    cur = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert fetch(df.collect(), df.columns) == fetch(cur.fetchall(), names)


def test_contract(spark):
    queries, checks = entry_module.queries(), entry_module.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) > 80
    flagship = entry_module.entry(spark)
    assert {"zone_id", "severity", "reason"} <= set(flagship.columns)


def test_no_cross_joins_in_plans(spark):
    for name in ("j1_nearest_join", "training_set", "a17_ignition_probability", "g4_zone_date_spine"):
        plan = entry_module.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
