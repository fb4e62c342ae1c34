import json

import pytest

from scour.operators import stats


def test_outliers_iqr_keeps_nulls_by_default(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 21)] + [(1000.0,), (None,)], "v double")
    kept = [r.v for r in stats.handle_outliers(df, ["v"]).collect()]
    assert 1000.0 not in kept and None in kept and len(kept) == 21
    dropped = stats.handle_outliers(df, ["v"], keep_nulls=False)
    assert dropped.count() == 20


def test_outliers_sequential_vs_single_pass(spark):
    data = [(float(i), float(i)) for i in range(1, 41)] + [(500.0, 1.0), (1.0, 20.0), (2.0, 30.0)]
    df = spark.createDataFrame(data, "a double, b double")
    seq = stats.handle_outliers(df, ["a", "b"], sequential=True).count()
    one = stats.handle_outliers(df, ["a", "b"], sequential=False).count()
    assert seq >= one - 1 and seq <= len(data)


def test_outliers_empty_column_removes_nothing_and_bad_method(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "v double, k int")
    assert stats.handle_outliers(df, ["v"]).count() == 2
    with pytest.raises(ValueError):
        stats.handle_outliers(df, ["k"], method="zscore")


def test_outliers_nan_like_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "v double")
    assert stats.handle_outliers(df, ["v"]).count() == 4
    assert stats.handle_outliers(df, ["v"], keep_nulls=False).count() == 3


def test_standardize_constant_and_types(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 1.0, "y"), (3, 1.0, "z")], "i int, k double, s string")
    out = stats.standardize(df)
    assert dict(out.dtypes)["i"] == "double"
    assert sorted(r.i for r in out.collect()) == [-1.0, 0.0, 1.0]
    assert {r.k for r in out.collect()} == {1.0}     # zero stddev: unchanged
    one = spark.createDataFrame([(5.0,)], "v double")
    assert stats.standardize(one).first().v == 5.0   # null stddev: unchanged


def test_profile_and_explore(spark):
    df = spark.createDataFrame([(float(i), i, "s%d" % i) for i in range(1, 101)], "d double, i int, s string")
    p = {r.column_name: r for r in stats.profile(df).collect()}
    assert set(p) == {"d", "i"}
    assert p["d"]["count"] == 100 and p["d"]["p25"] == 25.75 and p["d"]["p75"] == 75.25
    assert p["i"]["min"] == 1.0 and p["i"]["max"] == 100.0
    rep = stats.explore(df)
    assert rep["total_rows"] == 100 and rep["columns"] == ["d", "i", "s"]
    by = {e["summary"]: e for e in rep["summary"]}
    assert by["count"]["s"] == 100 and by["min"]["s"] == "s1" and by["50%"]["d"] == 50.5
    assert list(by) == ["count", "mean", "stddev", "min", "25%", "50%", "75%", "max"] and by["mean"]["s"] is None
    assert json.loads(stats.explore_json(df)) == rep
    nested = spark.createDataFrame([(({"a": 1},),)], "s struct<m:map<string,int>>")
    assert stats.explore(nested)["summary"][0]["s"] == 1


def test_observe_rows(spark, tmp_dir):
    df, obs = stats.observe_rows(spark.range(7), "n")
    df.write.mode("overwrite").parquet(tmp_dir + "/o")
    assert obs.get["rows"] == 7
