import pytest
from pyspark.sql import functions as F

from scour.operators import tables


def test_reference_keyed_update_and_delete(spark):
    people = spark.createDataFrame([(1, "a")], "id int, name string")
    key = tables.pick_key(people.columns, primary_key=["id"])
    changes = spark.createDataFrame([(1, "b")], "id int, name string")
    updated = tables.update_rows(people, changes, key)
    assert [tuple(r) for r in updated.collect()] == [(1, "b")]
    assert tables.delete_rows(updated, [1], key).count() == 0
    assert tables.count_matches(people, [1], key) == 1


def test_reference_no_key_refused(spark):
    nopk = spark.createDataFrame([("a",)], "name string")
    key = tables.pick_key(nopk.columns)
    assert key is None
    with pytest.raises(ValueError, match="no key column"):
        tables.update_rows(nopk, spark.createDataFrame([("b",)], "name string"), key)


def test_reference_id_column_without_key(spark):
    t = spark.createDataFrame([(1, "a"), (2, "c")], "id int, name string")
    key = tables.pick_key(t.columns)
    assert key == "id"
    up = tables.update_rows(t, spark.createDataFrame([(1, "b")], "id int, name string"), key)
    assert sorted(tuple(r) for r in up.collect()) == [(1, "b"), (2, "c")]
    assert tables.delete_rows(up, ["2"], key).count() == 1      # text key is coerced


def test_update_ignores_key_and_unknown_columns_and_checks_uniqueness(spark):
    t = spark.createDataFrame([(1, "a", 5)], "id int, name string, n int")
    ch = spark.createDataFrame([(1, "zzz")], "id int, other string")
    assert tables.update_rows(t, ch, "id").first().name == "a"
    dup = spark.createDataFrame([(1, "x"), (1, "y")], "id int, name string")
    with pytest.raises(ValueError, match="more than once"):
        tables.update_rows(t, dup, "id")
    typed = tables.update_rows(t, spark.createDataFrame([(1, "12")], "id int, n string"), "id",
                               coerce=True)
    assert typed.first().n == 12


def test_clickhouse_key_choice():
    assert tables.pick_key(["x", "id"], dialect="clickhouse") == "id"
    assert tables.pick_key(["x", "y"], dialect="clickhouse") == "x"


def test_pages(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    p = tables.page(df, [("id", "desc")], offset=10, limit=5)
    assert [r.id for r in p.collect()] == [89, 88, 87, 86, 85]
    with pytest.raises(ValueError):
        tables.page(df, [], 0, 5)
    deep = tables.page(df, [("id", "desc")], offset=10, limit=tables.SHALLOW)
    assert [r.id for r in deep.collect()] == list(range(89, -1, -1))
    assert tables.page(df.limit(0), ["id"], offset=tables.SHALLOW, limit=5).count() == 0
    nxt = tables.page_after(df, "id", after=41, limit=3)
    assert [r.id for r in nxt.collect()] == [42, 43, 44]
    ids = tables.with_rowid(p, [("id", "desc")], offset=10).orderBy("_rowid").collect()
    assert [r._rowid for r in ids] == ["10", "11", "12", "13", "14"]
    assert tables.with_rowid(p, [], key="id").first()._rowid == str(p.first().id)


def test_coerce_columns(spark):
    df = spark.createDataFrame([("",), ("12",), (" 7 ",), ("1.5",), ("1e3",), ("yes",), ("abc",), (None,)],
                               "raw string")
    t = df.select("raw", F.col("raw").alias("i"), F.col("raw").alias("d"), F.col("raw").alias("b"))
    out = {r.raw: r for r in tables.coerce_columns(t, {"i": "bigint", "d": "double", "b": "boolean"}).collect()}
    assert out["12"].i == 12 and out[" 7 "].i == 7 and out["1.5"].i is None and out["1.5"].i_rejected
    assert out["1e3"].d == 1000.0 and out["1e3"].i is None
    assert out["yes"].b is True and out["abc"].b_rejected and not out[""].i_rejected
    assert out[None].i is None and out[None].i_rejected is False


def test_structure_and_nan_to_null(spark):
    df = spark.createDataFrame([(1, float("nan"), "x")], "a int, `b c` double, s string")
    st = [tuple(r) for r in tables.structure(df).collect()]
    assert st == [(0, "a", "int", True), (1, "b c", "double", True), (2, "s", "string", True)]
    assert tables.nan_to_null(df).first()["b c"] is None


def test_keyset_pages_meet_every_row_once(spark):
    rows = [(k, i) for i, k in enumerate([1, 1, 2, 2, 3, None, None, 2, 1, None])]
    df = spark.createDataFrame(rows, "k int, i int").repartition(3)
    for down in (False, True):
        seen, after = [], None
        while got := tables.page_after(df, ["k", "i"], after, limit=3, descending=down).collect():
            seen += [(r.k, r.i) for r in got]
            after = seen[-1]
        assert sorted(seen, key=str) == sorted(rows, key=str)
        keys = [k for k, _ in seen if k is not None]
        assert keys == sorted(keys, reverse=down) and seen[-1][0] is None
    with pytest.raises(ValueError):
        tables.page_after(df, ["k", "i"], after=3)


def test_deletes_keep_the_column_order(spark):
    from scour.operators import auditlog
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, id int")
    assert tables.delete_rows(df, [1], "id").columns == ["name", "id"]
    assert [tuple(r) for r in tables.delete_rows(df, [1], "id").collect()] == [("b", 2)]
    assert auditlog.delete_entries(df, [2]).columns == ["name", "id"]


def test_numbers_must_look_like_numbers(spark):
    texts = ["12d", "3F", "0x1p3", "1.5", " -2e3 ", ".5", "7.", "", None, "nan", "Infinity", "1e", "--1"]
    df = spark.createDataFrame([(t, t, t) for t in texts], "v string, w string, b string")
    out = tables.coerce_columns(df, {"v": "double", "w": "Nullable(Decimal(10, 2))", "b": "Nullable(Bool)"}).collect()
    ok = {t: r.v for t, r in zip(texts, out) if not r.v_rejected}
    assert {t for t in ok} == {"1.5", " -2e3 ", ".5", "7.", "", None, "nan", "Infinity"} and ok[" -2e3 "] == -2000.0
    assert [r.w_rejected for r in out] == [t not in ("1.5", " -2e3 ", ".5", "7.", "", None) for t in texts]
    words = spark.createDataFrame([("Yes",), (" yes",), ("0",)], "b string")
    assert [r.b for r in tables.coerce_columns(words, {"b": "Bool"}).collect()] == [True, None, False]


def test_clickhouse_type_names():
    from scour.functions.coerce import parse_type
    names = {"Nullable(Int32)": "int", "UInt8": "smallint", "UInt64": "decimal(20,0)", "LowCardinality(Nullable(String))": "string",
             "Float64": "double", "DateTime64(3, 'UTC')": "timestamp", "Int256": "decimal(38,0)", "bigint": "bigint", "Decimal(10, 2)": "decimal(10,2)"}
    assert {n: parse_type(n).simpleString() for n in names} == names


def test_pick_key_needs_columns():
    assert tables.pick_key(["a", "id"], ["a", "b"]) == "a" and tables.pick_key(["a"]) is None
    with pytest.raises(ValueError):
        tables.pick_key([], dialect="clickhouse")
