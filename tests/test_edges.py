"""FIXTURES §4 edge rows across operators: empty tables, all-null columns, odd types."""

from decimal import Decimal

from scour.functions.columns import numeric_columns
from scour.operators import cleaning, stats, tables, verify
from scour.plans import spec


def test_numeric_detection_includes_short_and_decimal(spark):
    df = spark.createDataFrame([(1, 2, Decimal("1.50"), "x", True)],
                               "a short, b byte, c decimal(5,2), s string, f boolean")
    assert numeric_columns(df) == ["a", "b", "c"]
    out = stats.standardize(spark.createDataFrame(
        [(1, Decimal("1.0")), (3, Decimal("3.0"))], "a short, c decimal(5,2)"))
    assert sorted(r.a for r in out.collect()) == [-0.7071067811865475, 0.7071067811865475]


def test_empty_table_everywhere(spark):
    empty = spark.createDataFrame([], "k int, v double, s string")
    assert stats.profile(empty).collect()[0]["count"] == 0
    assert stats.handle_outliers(empty).count() == 0
    assert stats.standardize(empty).count() == 0
    assert cleaning.fill_na(empty, method="median").count() == 0
    assert cleaning.fill_na(empty, method="mode").count() == 0
    rep = stats.explore(empty)
    assert rep["total_rows"] == 0
    assert {r.check_name: r.ok for r in verify.verification(empty, empty).collect()} == \
        {"row_count": True, "checksum": True}
    assert verify.row_diff(empty, empty).count() == 0
    assert tables.page(empty, ["k"], 0, 10).count() == 0


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "k int, v double")
    assert cleaning.fill_na(df, method="mean").where("v is null").count() == 3
    assert stats.handle_outliers(df, ["v"]).count() == 3
    assert stats.standardize(df, ["v"]).where("v is null").count() == 3
    p = {r.column_name: r for r in stats.profile(df).collect()}
    assert p["v"]["count"] == 0 and p["v"]["p50"] is None and p["k"]["p50"] == 2.0


def test_single_row(spark):
    one = spark.createDataFrame([(5, 2.5)], "k int, v double")
    assert stats.handle_outliers(one).count() == 1
    assert stats.standardize(one).first().v == 2.5
    assert stats.profile(one).where("column_name = 'v'").first()["p25"] == 2.5


def test_duplicate_key_different_payload(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert cleaning.dedup(df).count() == 2
    assert cleaning.dedup(df, ["k"], order_by=[("v", "desc")]).first().v == "b"


def test_nan_beside_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (2.0,)], "v double")
    assert cleaning.drop_na(df).count() == 2
    p = stats.profile(df).first()
    assert p["count"] == 2 and p["mean"] == 1.5
    assert tables.nan_to_null(df).where("v is null").count() == 2


def test_unknown_operator_type_raises(spark):
    import pytest
    with pytest.raises(ValueError, match="unknown type"):
        spec.build(spark, {"source": {"type": "parquet", "path": "/nonexistent"},
                           "operators": [{"type": "magic"}]})
