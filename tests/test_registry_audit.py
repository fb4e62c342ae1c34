import datetime as dt

from pyspark.sql import functions as F

from scour.functions.text import redact_secrets, truncate_text
from scour.operators import auditlog, registry

T0 = dt.datetime(2024, 1, 1)


def reg(spark):
    return spark.createDataFrame(
        [(1, "orders", "mysql", "db1", 10, T0, T0), (2, "logs", "minio", "s3", 3, T0, T0),
         (3, "events", "clickhouse", "ck", 5, T0, T0)], registry.REGISTRY_SCHEMA)


def test_upsert_add_set_and_new(spark):
    batch = spark.createDataFrame([("orders", "postgres", "pg", 7, ), ("logs", "minio", "s3b", 2),
                                   ("fresh", "mysql", "db1", 4)],
                                  "table_name string, source_type string, source_name string, row_count bigint")
    add = {r.table_name: r for r in registry.upsert_registry(reg(spark), batch, mode="add").collect()}
    assert add["orders"].row_count == 17 and add["orders"].source_type == "postgres"
    assert add["logs"].row_count == 5 and add["events"].row_count == 5
    assert add["fresh"].id == 4 and add["fresh"].row_count == 4
    exact = {(r.table_name, r.source_type): r for r in
             registry.upsert_registry(reg(spark), batch, mode="set", match_class=False).collect()}
    assert exact[("orders", "mysql")].row_count == 10          # postgres != mysql here
    assert exact[("orders", "postgres")].row_count == 7
    assert exact[("logs", "minio")].row_count == 2


def test_catalog_search_remove_duplicates(spark):
    files = spark.createDataFrame([("Orders.csv", "/d/Orders.csv", 1.5, "Local File")],
                                  "name string, path string, size_kb double, source string")
    cat = registry.catalog(files, reg(spark))
    assert {r.type for r in cat.collect()} == {"file", "table", "bucket"}
    hits = registry.search_assets(cat, "ORD").collect()
    assert {r.name for r in hits} == {"Orders.csv", "orders"}
    assert [r.size for r in hits if r.type == "file"] == ["1.50 KB"]
    assert registry.search_assets(cat, None, "bucket").count() == 1
    assert registry.search_assets(cat, limit=2, offset=1).count() == 2
    left = registry.remove_assets(reg(spark), ids=[1], names=["logs"])
    assert [r.table_name for r in left.collect()] == ["events"]
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "s string, l string")
    assert [(r.s, r.n) for r in registry.duplicates(df, ["s", "l"]).collect()] == [("a", 2)]
    assert registry.new_only(df, df.where("s = 'a'"), ["s"]).count() == 1


def test_redaction_reference_case(spark):
    text = ("connect failed: mysql+pymysql://root:s3cret@db:3306/x, "
            "extra password=hunter2 and PWD : abc,def")
    df = spark.createDataFrame([(text,)], "t string")
    out = df.select(redact_secrets(F.col("t")).alias("t")).first().t
    assert "s3cret" not in out and "hunter2" not in out and "abc" not in out
    assert "mysql+pymysql://root:****@db:3306/x" in out and "password=****" in out
    assert out.endswith("PWD : ****,def")


def test_truncate(spark):
    df = spark.createDataFrame([("x" * 8001,), ("y" * 8000,)], "t string")
    out = [r.t for r in df.select(truncate_text(F.col("t")).alias("t")).collect()]
    assert out[0] == "x" * 8000 + "\n...<truncated>" and out[1] == "y" * 8000


def log(spark):
    rows = [(1, "u", "create_task", "t1", "ok", T0), (2, "system", "task_failed", "t1", "boom", T0 + dt.timedelta(1)),
            (3, "u", "update_row", "t1", "fine", T0 + dt.timedelta(2)),
            (4, "system", "verification_failed", "t2", "Rows mismatch", T0),
            (5, "u", "delete_row", "t2", None, T0 + dt.timedelta(3))]
    return spark.createDataFrame(rows, auditlog.LOG_SCHEMA)


def test_audit_queries(spark):
    lg = log(spark)
    assert auditlog.count_log(lg, user_id="u") == 3
    assert auditlog.count_log(lg, user_id="u", resource="t2") == 1
    assert [r.id for r in auditlog.newest_first(lg, 0, 2).collect()] == [5, 3]
    assert auditlog.delete_entries(lg, [1, 2, 99]).count() == 3
    assert auditlog.count_deleted(lg, [1, 2, 99]) == 2
    assert auditlog.delete_entries(lg, []).count() == 5
    warn = {r.id: r.warning for r in auditlog.flag_warnings(lg).collect()}
    assert warn == {1: False, 2: True, 3: False, 4: True, 5: True}
    last = {r.resource: (r.failure_action, r.details) for r in auditlog.last_failure(lg).collect()}
    assert last == {"t1": ("task_failed", "boom"), "t2": ("verification_failed", "Rows mismatch")}
    assert auditlog.search_by_name(lg, "action", "row", "user_id", "u").count() == 2


def test_audit_entry_and_summary(spark, tmp_dir):
    e = auditlog.audit_entry(spark, "system", "task_failed", "job",
                             "failed with password=abc " + "z" * 9000)
    d = e.first().details
    assert "abc" not in d and d.endswith("<truncated>")
    auditlog.append_log(e, tmp_dir + "/log")
    auditlog.append_log(e, tmp_dir + "/log")
    assert spark.read.parquet(tmp_dir + "/log").count() == 2
    names = spark.createDataFrame([("b",), ("a",)], "name string")
    assert auditlog.deleted_summary(names).first().details == "Deleted 2 tasks: a, b"


def test_upsert_makes_one_entry_per_key(spark):
    reg = spark.createDataFrame([(4, "t", "mysql", "a", 10, T0, T0), (2, "t", "postgres", "b", 20, T0, T0)], registry.REGISTRY_SCHEMA)
    batch = spark.createDataFrame([("t", "mysql", "a", 3), ("t", "mysql", "a", 4), ("new", "csv", "x", 1), ("new", "csv", "x", 2)],
                                  "table_name string, source_type string, source_name string, row_count bigint")
    add = {r.id: r.row_count for r in registry.upsert_registry(reg, batch, mode="add").collect()}
    assert add == {2: 27, 4: 10, 5: 3}      # the oldest entry of the class grows, the other stays
    put = {r.id: r.row_count for r in registry.upsert_registry(reg, batch, mode="set").collect()}
    assert put == {2: 4, 4: 10, 5: 2}
