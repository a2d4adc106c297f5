"""Every query with SQL against DuckDB on the smallest tables, and the shape of some plans."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from weftline.operators import repair
from weftline.plans import catalogue

SF = Path("/root/testdata/sf0.001")


def values(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, str(SF))
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert values(tuple(r[c] for c in columns) for r in df.collect()) == values(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["rule_report", "fk_integrity", "exact_match_rate", "quality_metrics", "nearest_time_peer", "encode_frequency", "opinion_consistency"])
def test_plan_stays_in_the_jvm(spark, name):
    plan = contract.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))


def test_filters_and_columns_reach_the_scan(spark):
    plan = contract.queries()["rule_range"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_draws_whose_points_are_borders_equal_sql(spark, tmp_path):
    """Of 11,200 rows every sixteenth ends on a point, or would if doubles were exact."""
    spark.range(11_200).selectExpr("id AS c_custkey", "'OTHER' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = contract.queries()["systematic_draws"](spark, str(tmp_path)).select("c_custkey", "times").collect()
    want = c.sql(catalogue.oracle_sql()["systematic_draws"]).fetchall()
    assert values(map(tuple, got)) == values(want)
    customers = spark.read.parquet(f"{tmp_path}/customer.parquet").selectExpr("c_custkey", "1.0D AS w")
    assert repair.systematic(customers, "w", 700, ["c_custkey"]).count() == 700 != sum(n for _, n in want)
