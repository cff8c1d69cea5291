"""Every catalogue query against DuckDB on the smallest tables."""

import pytest

from tarnlight.plans.catalogue import ORACLES, QUERIES
from tools.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    said = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert said.startswith(("ok", "rows only")), said


def test_no_python_in_plans(spark):
    for name, f in QUERIES.items():
        if name.startswith(("lp_", "msgpack_", "json_")):
            continue
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapInArrow" not in plan, name


def test_filters_reach_the_scan(spark):
    plan = QUERIES["time_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in plan


def test_customers_of_many_keys_stay_in_three_hours(spark, tmp_path):
    import duckdb

    spark.range(12_000).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "double(id) AS c_acctbal").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert compare(spark, c, QUERIES["svc_compact_candidates"], ORACLES["svc_compact_candidates"], str(tmp_path)) == "ok 3"
