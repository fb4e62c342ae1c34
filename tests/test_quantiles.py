import numpy as np
import pandas as pd
import pytest

from scour.operators.quantiles import quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def expected(values, probs):
    arr = np.array([v for v in values if v is not None and not np.isnan(v)], dtype=float)
    if len(arr) == 0:
        return [None] * len(probs)
    return [float(np.quantile(arr, p)) for p in probs]


def check(spark, values, **kw):
    df = spark.createDataFrame(pd.DataFrame({"v": pd.Series(values, dtype="float64")}))
    got = quantiles(df, ["v"], PROBS, **kw)["v"]
    exp = expected(values, PROBS)
    for g, e in zip(got, exp):
        if e is None:
            assert g is None
        else:
            assert g == pytest.approx(e, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("local_rows,buckets", [(50_000, 4096), (20, 8), (1, 2)])
def test_exact_matches_numpy(spark, local_rows, buckets):
    rng = np.random.default_rng(3)
    values = list(rng.lognormal(size=4000)) + [None] * 5 + [float("nan")] * 5
    check(spark, values, local_rows=local_rows, buckets=buckets)


def test_hot_value_holding_a_third(spark):
    rng = np.random.default_rng(4)
    values = list(rng.normal(size=2000)) + [3.25] * 1000
    check(spark, values, local_rows=10, buckets=4)


def test_coarse_sketch_only_costs_passes(spark):
    rng = np.random.default_rng(5)
    values = list(rng.exponential(size=6000)) + [float(i) for i in range(300)]
    check(spark, values, local_rows=100, buckets=16, accuracy=8)


def test_ranks_the_sketch_missed_are_found_in_the_gaps(spark, monkeypatch):
    from scour.operators import quantiles as q
    monkeypatch.setattr(q._Refiner, "_margin", lambda self: 1e-6)
    rng = np.random.default_rng(6)
    check(spark, list(rng.normal(size=5000)), local_rows=50, buckets=8, accuracy=8)


def test_wide_table_takes_two_scans(spark, tmp_dir):
    rng = np.random.default_rng(7)
    data = pd.DataFrame(rng.normal(size=(4000, 64)), columns=[f"c{i}" for i in range(64)])
    spark.createDataFrame(data).write.parquet(tmp_dir + "/wide")
    df = spark.read.parquet(tmp_dir + "/wide")
    passes = []
    from scour.operators import quantiles as q
    refine = q._Refiner._refine
    q._Refiner._refine = lambda self, todo: passes.append(len(todo)) or refine(self, todo)
    try:
        got = quantiles(df, None, [0.25, 0.5, 0.75])
    finally:
        q._Refiner._refine = refine
    assert passes == [64]
    for c in data:
        assert got[c] == pytest.approx([float(np.quantile(data[c], p)) for p in (0.25, 0.5, 0.75)], rel=1e-12)


def test_infinities_are_extreme_values(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (float("inf"),)],
                               "v double")
    got = quantiles(df, ["v"], [0.0, 0.5, 1.0], local_rows=1, buckets=2)["v"]
    assert got == [float("-inf"), 2.0, float("inf")]


def test_all_null_and_empty(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert quantiles(df, ["v"], [0.5])["v"] == [None]
    empty = spark.createDataFrame([], "v double")
    assert quantiles(empty, ["v"], [0.25, 0.75])["v"] == [None, None]


def test_integer_and_decimal_columns(spark):
    from decimal import Decimal
    df = spark.createDataFrame([(i, Decimal(i)) for i in range(1, 101)], "i int, d decimal(10,2)")
    got = quantiles(df, ["i", "d"], [0.25, 0.75])
    assert got["i"] == [25.75, 75.25]
    assert got["d"] == [25.75, 75.25]


def test_approximate(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    q1, q3 = quantiles(df, ["v"], [0.25, 0.75], error=0.05)["v"]
    assert abs(q1 - 25) <= 5 and abs(q3 - 75) <= 5


def test_rejects_non_numeric_and_bad_probability(spark):
    df = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(ValueError):
        quantiles(df, ["s"], [0.5])
    with pytest.raises(ValueError):
        quantiles(spark.range(3), ["id"], [1.5])


def test_low_cardinality_one_value_brackets(spark):
    values = [float(i % 5) for i in range(6000)] + [2.5] * 7
    check(spark, values, local_rows=100, buckets=8)
