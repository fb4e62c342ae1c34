import math

import pytest
from pyspark.sql import functions as F

from scour.operators import cleaning


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_dedup_whole_row_nan_null_negzero(spark):
    df = spark.createDataFrame([(float("nan"), None, 0.0), (float("nan"), None, -0.0),
                                (1.0, "a", 1.0), (1.0, "a", 1.0), (2.0, None, None),
                                (2.0, None, None)], "x double, s string, z double")
    assert cleaning.dedup(df).count() == 3


def test_dedup_by_key_keeps_one_row_per_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    out = cleaning.dedup(df, ["k"])
    assert sorted(r.k for r in out.collect()) == [1, 2]


def test_dedup_by_key_with_order_is_deterministic(spark):
    df = spark.createDataFrame([(1, 10, "old"), (1, 20, "new"), (1, 20, "also"), (2, 5, "x")],
                               "k int, ts int, v string")
    out = cleaning.dedup(df, ["k"], order_by=[("ts", "desc")])
    # ties on ts are broken by the remaining columns, ascending
    assert rows(out) == [(1, 20, "also"), (2, 5, "x")]


def test_dedup_refuses_map_columns(spark):
    df = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    with pytest.raises(ValueError, match="MAP"):
        cleaning.dedup(df)


def test_dedup_drops_whole_row_copies_only(spark):
    rows = [("kiwi", 4, None), ("plum", 4, 1.5), ("kiwi", 4, None), ("kiwi", 5, None), ("kiwi", 4, None)]
    out = cleaning.dedup(spark.createDataFrame(rows, "fruit string, box int, kg double"))
    assert sorted(map(str, out.collect())) == sorted(map(str, cleaning.dedup(out).collect())) and out.count() == 3


def test_fill_na_without_columns_refuses_a_lossy_fill(spark):
    from decimal import Decimal
    df = spark.createDataFrame([(None, None, None)], "i int, m decimal(10,2), s string")
    with pytest.raises(ValueError, match="truncated"):
        cleaning.fill_na(df, 2.7)
    assert cleaning.fill_na(df, 0.29, columns=["m"]).first().m == Decimal("0.29")
    with pytest.raises(ValueError, match="truncated"):
        cleaning.fill_na(df, 0.295, columns=["m"])
    with pytest.raises(ValueError, match="truncated"):
        cleaning.fill_na(df, 123456789.0, columns=["m"])


def test_modes_of_all_types_in_one_pass(spark):
    import datetime as dt
    from decimal import Decimal
    rows = [(1, 2.5, "b", Decimal("1.10"), True, dt.date(2020, 1, 2), b"x"), (1, 2.5, "a", Decimal("1.10"), False, dt.date(2020, 1, 2), b"x"),
            (2 ** 60 + 1, float("nan"), "a", None, None, None, b"y"), (2 ** 60 + 1, None, "b", None, None, dt.date(2021, 1, 2), None)]
    df = spark.createDataFrame(rows, "i bigint, d double, s string, m decimal(10,2), f boolean, t date, b binary")
    assert cleaning.mode_values(df, df.columns) == {
        "i": 1, "d": 2.5, "s": "a", "m": Decimal("1.10"), "f": False, "t": dt.date(2020, 1, 2), "b": b"x"}
    assert cleaning.mode_values(df.limit(0), ["i", "b"]) == {"i": None, "b": None}


def test_filter_rows_sql_predicate(spark):
    df = spark.range(10)
    assert cleaning.filter_rows(df, "id % 2 = 0 AND id > 3").count() == 3
    with pytest.raises(ValueError):
        cleaning.filter_rows(df, "  ")


def test_fill_na_matches_types_only(spark):
    df = spark.createDataFrame([(None, None, None)], "i int, d double, s string")
    out = cleaning.fill_na(df, "x").first()
    assert (out.i, out.d, out.s) == (None, None, "x")
    out = cleaning.fill_na(df, 0).first()
    assert (out.i, out.d, out.s) == (0, 0.0, None)


def test_fill_na_string_stays_string(spark):
    df = spark.createDataFrame([(None,), ("7",)], "s string")
    assert rows(cleaning.fill_na(df, "0123")) == [("0123",), ("7",)]


def test_fill_na_rejects_lossy_and_wrong_type_and_none(spark):
    df = spark.createDataFrame([(None, None)], "i int, s string")
    with pytest.raises(ValueError, match="truncated"):
        cleaning.fill_na(df, 2.7, columns=["i"])
    with pytest.raises(ValueError, match="does not match"):
        cleaning.fill_na(df, 1, columns=["s"])
    with pytest.raises(ValueError):
        cleaning.fill_na(df, None)
    # without a subset, a fraction is only put where it fits
    out = cleaning.fill_na(spark.createDataFrame([(None, None)], "i int, d double"), 2.5, columns=["d"]).first()
    assert out.i is None and out.d == 2.5


def test_fill_na_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "d double")
    assert rows(cleaning.fill_na(df, 0.0)) == [(0.0,), (0.0,), (1.0,)]


def test_fill_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,), (None,)], "v double")
    assert rows(cleaning.fill_na(df, method="mean"))[-1] == (10.0,)
    mean = [r.v for r in cleaning.fill_na(df, method="mean").collect()]
    assert 3.75 in mean
    med = [r.v for r in cleaning.fill_na(df, method="median").collect()]
    assert med.count(2.0) == 3
    mode = [r.v for r in cleaning.fill_na(df, method="mode").collect()]
    assert mode.count(2.0) == 3
    ints = spark.createDataFrame([(1,), (2,), (None,)], "i int")
    assert sorted(r.i for r in cleaning.fill_na(ints, method="mean").collect()) == [1, 2, 2]


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert cleaning.mode_values(df, ["s"]) == {"s": "a"}


def test_drop_na_any_and_subset(spark):
    df = spark.createDataFrame([(1.0, None), (None, "x"), (2.0, "y"), (float("nan"), "z")],
                               "a double, b string")
    assert cleaning.drop_na(df).count() == 1
    assert cleaning.drop_na(df, ["b"]).count() == 3
    assert cleaning.drop_na(df, how="all").count() == 4


def test_rename_swap_and_odd_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, `x.y z` int")
    out = cleaning.rename_columns(df, {"a": "b", "b": "a", "x.y z": "名字", "nope": "q"})
    assert out.columns == ["b", "a", "名字"]
    assert tuple(out.first()) == (1, 2, 3)
    with pytest.raises(ValueError, match="duplicate"):
        cleaning.rename_columns(df, {"a": "b"})


def test_operators_on_dotted_names(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None)], "`a.b` string, `c d` double")
    out = cleaning.fill_na(df, "z")
    assert rows(out, "a.b") == [("a",), ("z",)]
    assert cleaning.drop_na(df, ["c d"]).count() == 1
    assert cleaning.dedup(df, ["a.b"]).count() == 2


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert cleaning.dedup(empty).count() == 0
    assert cleaning.fill_na(empty, "x").count() == 0
    one = spark.createDataFrame([(1, "a")], "a int, b string")
    assert cleaning.dedup(one, ["a"], order_by=["b"]).count() == 1
    assert not math.isnan(1.0)
