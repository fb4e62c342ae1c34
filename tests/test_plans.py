"""Plan-shape guards: what must hold for every registered query at any scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from scour.plans.queries import QUERIES
from scour.operators import auditlog, cleaning

SF = "/root/testdata/sf0.001"
BYTE_MOVERS = {"object_copy", "csv_splits"}    # bytes of objects and of byte ranges, on the executors


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_no_python_rows(spark, name):
    plan = physical(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name not in BYTE_MOVERS:
        assert "MapInPandas" not in plan and "PythonMapInArrow" not in plan


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_reach_the_scan(spark):
    plan = formatted(E.queries()["filter_sql"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "GreaterThan(l_quantity,10.0)" in plan
    assert ("ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,"
            "l_discount:double,l_returnflag:string>") in plan


def skewed(spark):
    # one user holds a third of the rows
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 97).alias("k"),
        F.col("id").alias("ts"), (F.col("id") * 2).alias("v"))


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = skewed(spark)
    latest = cleaning.dedup(df, ["k"], order_by=[("ts", "desc")])
    plan = physical(latest)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert plan.index("Partial") > plan.index("Exchange")   # partial limit sits below the exchange
    assert {r.k: r.ts for r in latest.collect()}[7] == 2997
    distinct = physical(cleaning.dedup(df.select("k")))
    assert distinct.count("HashAggregate") == 2               # map-side combine, then final


def test_last_failure_limits_per_task(spark):
    df = skewed(spark).select(F.col("ts").alias("id"), F.lit("u").alias("user_id"),
                              F.when(F.col("v") % 10 == 0, "task_failed").otherwise("x").alias("action"),
                              F.concat(F.lit("t"), F.col("k").cast("string")).alias("resource"),
                              F.col("v").cast("string").alias("details"),
                              F.col("ts").cast("timestamp").alias("timestamp"))
    plan = physical(auditlog.last_failure(df))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_outlier_bounds_reach_the_scan(spark, tmp_dir):
    from scour.operators import stats
    path = tmp_dir + "/ints"
    spark.range(1000).selectExpr("cast(id as int) k", "id * 1.0 v").write.parquet(path)
    out = stats.handle_outliers(spark.read.parquet(path), ["k"], keep_nulls=False)
    plan = formatted(out)
    # q1 = 249.75, q3 = 749.25: integer bounds -499 .. 1498, pushed without a cast
    assert "GreaterThanOrEqual(k,-499)" in plan and "LessThanOrEqual(k,1498)" in plan
    assert out.count() == 1000
