"""Registered queries: one per operator family, each with its DuckDB oracle.

Every query reads the driver tables (``{sf_dir}/<table>.parquet``) whole, or
inputs derived from them by one expression that the oracle repeats
(FIXTURES.md §3: NULLs, perturbed copies, change sets and logs are made with
``CASE`` on both sides).  Floating results are rounded to 6 digits on both
sides.  A query without an oracle entry is checked on row count only; the
reason is given next to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redact_secrets, truncate_text
from ..operators import auditlog, cleaning, edits, registry, stats, tables, verify
from ..operators.quantiles import quantiles
from ..session import scratch_path
from ..sinks import copy_objects, export_table, verify_copy, write_file
from ..sources import list_objects, read_csv, read_json, read_parquet, read_source, scan_data_dir
from ..streaming import dedup_ingest, dedup_stream, file_stream, ingest, poll_stream, poll_table
from . import spec as specs

R = 6                       # digits kept of floating results on both sides
ORACLE_DIR = "/root/testdata/sf0.01"   # where the oracle's file listings look


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{d}/{name}.parquet")


def _r(c) -> F.Column:
    return F.round(c if not isinstance(c, str) else F.col(c), R)


# -- derived inputs (same expression in the oracle) ------------------------------------

def orders_with_nulls(spark, d):
    o = _t(spark, d, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderpriority"))
         .alias("o_orderpriority"),
        F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_totalprice"))
         .alias("o_totalprice"))


ORDERS_NULLS_SQL = """orders_n AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice
  FROM orders)"""


def events_with_nulls(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", "user_id", "event_type",
                    F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"))


EVENTS_NULLS_SQL = """events_n AS (
  SELECT event_id, user_id, event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
  FROM events)"""


def perturbed_orders(spark, d):
    o = _t(spark, d, "orders")
    return o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 0,
                                               F.col("o_totalprice") + 1)
                        .otherwise(F.col("o_totalprice")))


PERTURBED_SQL = """copy AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders)"""


def registry_from_nation(spark, d):
    n = _t(spark, d, "nation")
    kind = (F.when(F.col("n_regionkey") == 0, "minio").when(F.col("n_regionkey") == 1, "clickhouse")
            .when(F.col("n_regionkey") == 2, "postgres").otherwise("mysql"))
    return n.select((F.col("n_nationkey") + 1).cast("bigint").alias("id"),
                    F.lower("n_name").alias("table_name"), kind.alias("source_type"),
                    F.concat(F.lit("src_"), F.col("n_regionkey").cast("string")).alias("source_name"),
                    (F.col("n_nationkey") * 100).cast("bigint").alias("row_count"),
                    F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
                    F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"))


REGISTRY_SQL = """reg AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, lower(n_name) AS table_name,
         CASE n_regionkey WHEN 0 THEN 'minio' WHEN 1 THEN 'clickhouse'
                          WHEN 2 THEN 'postgres' ELSE 'mysql' END AS source_type,
         'src_' || CAST(n_regionkey AS VARCHAR) AS source_name,
         CAST(n_nationkey * 100 AS BIGINT) AS row_count
  FROM nation)"""


def registry_batch(spark, d):
    """Sync results: every third nation again (with a new type) plus the regions."""
    n = _t(spark, d, "nation").where(F.col("n_nationkey") % 3 == 0)
    again = n.select(F.lower("n_name").alias("table_name"),
                     F.when(F.col("n_regionkey") == 0, "minio").otherwise("mysql").alias("source_type"),
                     F.lit("batch").alias("source_name"),
                     F.lit(7).cast("bigint").alias("row_count"))
    r = _t(spark, d, "region").select(F.lower("r_name").alias("table_name"),
                                      F.lit("postgres").alias("source_type"),
                                      F.lit("batch").alias("source_name"),
                                      (F.col("r_regionkey") * 10).cast("bigint").alias("row_count"))
    return again.unionByName(r)


BATCH_SQL = """batch AS (
  SELECT lower(n_name) AS table_name,
         CASE WHEN n_regionkey = 0 THEN 'minio' ELSE 'mysql' END AS source_type,
         'batch' AS source_name, CAST(7 AS BIGINT) AS row_count
  FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL
  SELECT lower(r_name), 'postgres', 'batch', CAST(r_regionkey * 10 AS BIGINT) FROM region)"""


def log_from_events(spark, d):
    """Audit log view of events: event_type is the action, ``error`` a task failure."""
    e = _t(spark, d, "events")
    action = F.when(F.col("event_type") == "error", "task_failed").otherwise(F.col("event_type"))
    details = F.concat(F.col("props"),
                       F.when(F.col("value") > 400, F.lit(" row deleted")).otherwise(F.lit("")))
    return e.select(F.col("event_id").alias("id"), F.col("user_id"), action.alias("action"),
                    F.concat(F.lit("task_"), (F.col("user_id") % 20).cast("string")).alias("resource"),
                    details.alias("details"), F.col("ts").alias("timestamp"))


LOG_SQL = """log AS (
  SELECT event_id AS id, user_id,
         CASE WHEN event_type = 'error' THEN 'task_failed' ELSE event_type END AS action,
         'task_' || CAST(user_id % 20 AS VARCHAR) AS resource,
         props || CASE WHEN value > 400 THEN ' row deleted' ELSE '' END AS details,
         ts AS timestamp
  FROM events)"""


def changes_from_customer(spark, d):
    c = _t(spark, d, "customer").where(F.col("c_custkey") % 10 == 0)
    return c.select("c_custkey", F.concat(F.lit("UPDATED-"), F.col("c_mktsegment")).alias("c_mktsegment"),
                    F.lit("ignored").alias("not_a_column"))


# -- P1 / P2 -------------------------------------------------------------------------------

def q_dedup_rows(spark, d):
    return cleaning.dedup(_t(spark, d, "events").select("user_id", "event_type"))


def q_dedup_key_latest(spark, d):
    e = _t(spark, d, "events")
    return (cleaning.dedup(e, ["user_id"], order_by=[("ts", "desc"), ("event_id", "desc")])
            .select("event_id", "user_id", "event_type", "ts", "value"))


# -- P3 ---------------------------------------------------------------------------------------

FILTER_CONDITION = "l_quantity > 10 AND l_returnflag = 'R' AND l_discount BETWEEN 0.02 AND 0.08"


def q_filter_sql(spark, d):
    return (cleaning.filter_rows(_t(spark, d, "lineitem"), FILTER_CONDITION)
            .select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"))


# -- P4 - P8 -------------------------------------------------------------------------------------

def q_fill_constant(spark, d):
    return cleaning.fill_na(orders_with_nulls(spark, d), "UNKNOWN")


def q_fill_subset(spark, d):
    return cleaning.fill_na(orders_with_nulls(spark, d), 0, columns=["o_totalprice"])


def _fill_stat(method):
    def q(spark, d):
        out = cleaning.fill_na(events_with_nulls(spark, d), columns=["value"], method=method)
        return out.select("event_id", _r("value").alias("value"))
    return q


def q_drop_any(spark, d):
    return cleaning.drop_na(orders_with_nulls(spark, d))


def q_drop_subset(spark, d):
    return cleaning.drop_na(orders_with_nulls(spark, d), ["o_orderpriority"])


# -- P9 -------------------------------------------------------------------------------------------

def q_rename_swap(spark, d):
    return cleaning.rename_columns(_t(spark, d, "part"), {"p_name": "p_brand", "p_brand": "p_name"})


# -- M1 - M5 --------------------------------------------------------------------------------------

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


def q_profile(spark, d):
    p = stats.profile(_t(spark, d, "lineitem"))
    return p.select("column_name", "count",
                    *[_r(c).alias(c) for c in ("mean", "stddev", "min", "p25", "p50", "p75", "max")])


def q_outliers_iqr(spark, d):
    e = _t(spark, d, "events")
    return (stats.handle_outliers(e, ["value", "user_id"], sequential=False)
            .select("event_id", "user_id", "value"))


def skewed_lineitem(spark, d):
    """Line items with a value that has real outliers: price to the fourth power, and its root."""
    x = F.col("l_extendedprice")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (x * x * x / 1e9).alias("cube"),
                                           (x / (F.col("l_quantity") * F.col("l_quantity"))).alias("unit"))


SKEWED_SQL = """skewed AS (SELECT l_orderkey, l_linenumber,
  l_extendedprice * l_extendedprice * l_extendedprice / 1e9 AS cube,
  l_extendedprice / (l_quantity * l_quantity) AS unit FROM lineitem)"""


def q_outliers_sequential(spark, d):
    return (stats.handle_outliers(skewed_lineitem(spark, d), ["unit", "cube"], sequential=True)
            .select("l_orderkey", "l_linenumber"))


def q_outliers_ranks(spark, d):
    # the approximate quartiles hold their promise: their true ranks are within the error
    li, error = _t(spark, d, "lineitem"), 0.05
    got = quantiles(li, ["l_extendedprice"], [0.25, 0.75], error=error)["l_extendedprice"]
    x, n = F.col("l_extendedprice"), F.count(F.lit(1))
    ranks = li.agg(*[c for i, (p, v) in enumerate(zip((0.25, 0.75), got)) for c in
                     ((F.count_if(x < F.lit(v)) / n <= p + error).alias(f"low{i}"),
                      (F.count_if(x <= F.lit(v)) / n >= p - error).alias(f"high{i}"))], n.alias("n"))
    return ranks.select("n", (F.col("low0") & F.col("high0")).alias("q1_ok"), (F.col("low1") & F.col("high1")).alias("q3_ok"))


def q_outliers_approx(spark, d):
    # the reference's Spark setting: approximate quartiles, relative error 0.05,
    # NULL rows dropped.  Approximate by design, so no oracle: rows only.
    li = _t(spark, d, "lineitem")
    return (stats.handle_outliers(li, ["l_extendedprice"], error=0.05, keep_nulls=False)
            .select("l_orderkey", "l_linenumber", "l_extendedprice"))


STANDARDIZE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def q_standardize(spark, d):
    out = stats.standardize(_t(spark, d, "lineitem"), STANDARDIZE_COLS)
    return out.select("l_orderkey", "l_linenumber", *[_r(c).alias(c) for c in STANDARDIZE_COLS])


# -- P11: a whole cleaning spec ----------------------------------------------------------------

def chain_spec(d: str) -> dict:
    return {"job_name": "lineitem_clean",
            "source": {"type": "parquet", "path": f"{d}/lineitem.parquet"},
            "operators": [{"type": "filter", "condition": "l_quantity > 10"},
                          {"type": "dedup"},
                          {"type": "outliers", "columns": ["l_extendedprice"]},
                          {"type": "standardize", "columns": ["l_quantity", "l_extendedprice"]}]}


def q_spec_chain(spark, d):
    df = specs.build(spark, chain_spec(d)).df
    return df.select("l_orderkey", "l_linenumber", _r("l_quantity").alias("l_quantity"),
                     _r("l_extendedprice").alias("l_extendedprice"), "l_returnflag")


# -- V2, V3, V9 ------------------------------------------------------------------------------------

def q_verify_counts(spark, d):
    v = verify.verification(_t(spark, d, "orders"), perturbed_orders(spark, d), checks=["row_count"])
    return v.select("check_name", F.col("source").cast("bigint").alias("source"),
                    F.col("target").cast("bigint").alias("target"), "ok")


def q_verify_checksum(spark, d):
    # crc32 has no DuckDB counterpart: rows only (two checks, checksum fails)
    return verify.verification(_t(spark, d, "orders"), perturbed_orders(spark, d))


def q_verify_checksum_ok(spark, d):
    # one table against itself in another order and layout, and against a changed copy
    orders = _t(spark, d, "orders")
    same = orders.repartition(7, "o_custkey").withColumn("o_custkey", F.col("o_custkey").cast("double"))
    a = verify.verification(orders, same).select(F.lit("same").alias("copy"), "check_name", "ok")
    b = verify.verification(orders, perturbed_orders(spark, d)).select(F.lit("changed").alias("copy"), "check_name", "ok")
    c = verify.verification(orders, lossy_copy(spark, d), algorithm="xxhash64")
    return a.unionAll(b).unionAll(c.select(F.lit("lossy").alias("copy"), "check_name", "ok"))


def q_status(spark, d):
    orders = _t(spark, d, "orders")
    out = [(name, verify.status(verify.verification(orders, copy))) for name, copy in
           (("same", orders), ("changed", perturbed_orders(spark, d)), ("lossy", lossy_copy(spark, d)))]
    return spark.createDataFrame(out, "copy string, status string")


def q_verify_diff(spark, d):
    return verify.row_diff(_t(spark, d, "orders"), perturbed_orders(spark, d))


# -- V7 / V8, T10-T12 ----------------------------------------------------------------------------------

FIXED_NOW = "2024-02-01 00:00:00"


def q_registry_upsert(spark, d):
    out = registry.upsert_registry(registry_from_nation(spark, d), registry_batch(spark, d),
                                   mode="add", match_class=True,
                                   now=F.lit(FIXED_NOW).cast("timestamp"))
    return out.select("id", "table_name", "source_type", "source_name", "row_count")


def q_registry_set(spark, d):
    out = registry.upsert_registry(registry_from_nation(spark, d), registry_batch(spark, d),
                                   mode="set", match_class=False,
                                   now=F.lit(FIXED_NOW).cast("timestamp"))
    return out.select("id", "table_name", "source_type", "source_name", "row_count")


def q_catalog_search(spark, d):
    assets = registry.catalog(scan_data_dir(spark, d), registry_from_nation(spark, d))
    return registry.search_assets(assets, "TION_1").select("id", "name", "type", "source", "rows")


def q_asset_remove(spark, d):
    return registry.remove_assets(registry_from_nation(spark, d), ids=[1, 5, 9],
                                  names=["nation_3"]).drop("created_at", "updated_at")


# -- T1 - T8 ------------------------------------------------------------------------------------------

PAGE_ORDER = [("c_acctbal", "desc"), ("c_custkey", "asc")]


def q_page(spark, d):
    return tables.page(_t(spark, d, "customer"), PAGE_ORDER, offset=100, limit=50) \
        .select("c_custkey", "c_name", "c_acctbal")


def q_page_rowid(spark, d):
    p = tables.page(_t(spark, d, "customer"), PAGE_ORDER, offset=100, limit=50)
    return tables.with_rowid(p, PAGE_ORDER, offset=100).select("c_custkey", "c_acctbal", "_rowid")


def q_update_rows(spark, d):
    return tables.update_rows(_t(spark, d, "customer"), changes_from_customer(spark, d), "c_custkey")


def q_delete_rows(spark, d):
    keys = _t(spark, d, "customer").where(F.col("c_custkey") % 10 == 0).select("c_custkey")
    return tables.delete_rows(_t(spark, d, "customer"), keys, "c_custkey")


def q_edit_files(spark, d):
    # a partitioned copy of orders, updated and then deleted from by key; the files without these keys stay as they are
    path, orders = scratch_path(spark, "orders-stored"), _t(spark, d, "orders")
    edits.store(orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").repartitionByRange(4, "o_orderkey"), path, ["o_orderstatus"])
    low = orders.agg(F.min("o_orderkey")).first()[0]
    changes = orders.where(F.col("o_orderkey") < low + 200).select("o_orderkey", F.lit(0.5).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"))
    one = edits.update_stored(spark, path, changes, "o_orderkey")
    two = edits.delete_stored(spark, path, orders.where(F.col("o_orderkey") < low + 50).select("o_orderkey"), "o_orderkey")
    if not (one.untouched and two.untouched):
        raise AssertionError("an edit of a narrow range of keys rewrote every file")
    return edits.read_stored(spark, path)


def dirty_text(spark, d):
    e = _t(spark, d, "events")
    k = F.col("event_id") % 5
    raw = (F.when(k == 0, F.lit("")).when(k == 1, F.col("user_id").cast("string"))
           .when(k == 2, F.col("value").cast("string"))
           .when(k == 3, F.when(F.col("user_id") % 2 == 0, F.lit("yes")).otherwise(F.lit("N")))
           .otherwise(F.lit("abc")))
    return e.select("event_id", raw.alias("raw"))


def q_coerce(spark, d):
    t = dirty_text(spark, d).select("event_id", "raw", F.col("raw").alias("as_int"),
                                    F.col("raw").alias("as_double"), F.col("raw").alias("as_bool"))
    return tables.coerce_columns(t, {"as_int": "bigint", "as_double": "double", "as_bool": "boolean"})


def q_structure(spark, d):
    return tables.structure(_t(spark, d, "part"))


# -- A1 - A12 --------------------------------------------------------------------------------------------

def q_audit_page(spark, d):
    log = auditlog.filter_log(log_from_events(spark, d), action="task_failed")
    return auditlog.newest_first(log, offset=20, limit=50) \
        .select("id", "user_id", "action", "resource", "timestamp")


def q_audit_count(spark, d):
    log = auditlog.filter_log(log_from_events(spark, d), action="purchase", resource="task_3")
    return log.agg(F.count(F.lit(1)).alias("total"))


def q_audit_delete(spark, d):
    log = log_from_events(spark, d)
    ids = log.where(F.col("id") % 3 == 0).select("id")
    return auditlog.delete_entries(log, ids).select("id", "action", "resource")


def q_audit_warning(spark, d):
    return auditlog.flag_warnings(log_from_events(spark, d)).select("id", "action", "warning")


def q_last_failure(spark, d):
    return auditlog.last_failure(log_from_events(spark, d))


def q_duplicates(spark, d):
    return registry.duplicates(_t(spark, d, "documents"), ["source", "lang"])


SECRET_SUFFIX = [" password=", " mysql+pymysql://u", ":pw", "@host/db PWD : "]


def q_redact(spark, d):
    doc = _t(spark, d, "documents")
    id_s = F.col("doc_id").cast("string")
    text = F.concat(F.col("text"), F.lit(SECRET_SUFFIX[0]), id_s, F.lit(SECRET_SUFFIX[1]), id_s,
                    F.lit(SECRET_SUFFIX[2]), id_s, F.lit(SECRET_SUFFIX[3]), id_s)
    return doc.select("doc_id", redact_secrets(text).alias("text"))


def q_truncate(spark, d):
    doc = _t(spark, d, "documents")
    return doc.select("doc_id", truncate_text(F.col("text")).alias("text"))


def q_deleted_summary(spark, d):
    reg = registry_from_nation(spark, d)
    gone = reg.where(F.col("source_type") == "minio").select(F.col("table_name").alias("name"))
    return auditlog.deleted_summary(gone)


# -- S1-S3, K1, K2, K9: file round trips -------------------------------------------------------------

def _roundtrip(fmt):
    def q(spark, d):
        sup = _t(spark, d, "supplier")
        path = scratch_path(spark, f"roundtrip-{fmt}")
        write_file(sup, fmt, path, "errorifexists")
        if fmt == "csv":
            return read_csv(spark, path, schema=sup.schema)
        if fmt == "json":
            return read_json(spark, path, schema=sup.schema)
        return read_parquet(spark, path)
    return q


# -- S8, S10, K8, V4: listings, object copy, digests --------------------------------------------------

def q_asset_scan(spark, d):
    return scan_data_dir(spark, d).select("name", "type", "size_bytes")


def q_object_copy(spark, d):
    src = list_objects(spark, d, pattern="*.parquet")
    target = scratch_path(spark, "bucket-copy")
    copy_objects(src, target)
    return verify_copy(src, target).select("Key", "ok")     # digests of what the target holds


# -- R1 / R2: streaming ingest -------------------------------------------------------------------------

def q_stream_ingest(spark, d):
    schema = _t(spark, d, "events").schema
    stream = file_stream(spark, d, "parquet", schema, pattern="events.parquet",
                         max_files_per_trigger=1)
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    ingest(stream, out, ckpt, available_now=True,
           transform=lambda s: cleaning.filter_rows(s, "value >= 1.0")
           .select("event_id", "user_id", "event_type", "value"))
    return read_parquet(spark, out)


# -- further operator coverage --------------------------------------------------------------------------

def q_dedup_key(spark, d):
    # P2 without an order: only the key columns are promised
    return cleaning.dedup(_t(spark, d, "events"), ["user_id", "event_type"]) \
        .select("user_id", "event_type")


def q_standardize_auto(spark, d):
    # P10: numeric columns found from the schema (p_partkey, p_size, p_retailprice)
    out = stats.standardize(_t(spark, d, "part"))
    return out.select(_r("p_partkey").alias("p_partkey"), "p_name", "p_brand", "p_type",
                      _r("p_size").alias("p_size"), _r("p_retailprice").alias("p_retailprice"))


def q_page_after(spark, d):
    return tables.page_after(_t(spark, d, "customer"), "c_custkey", after=700, limit=25) \
        .select("c_custkey", "c_name")


def q_page_after_ties(spark, d):
    # many events share a user: the page goes on behind (user, event), not behind the user
    return tables.page_after(_t(spark, d, "events"), ["user_id", "event_id"], after=(20, 0), limit=500) \
        .select("event_id", "user_id")


def q_page_deep(spark, d):
    # past what one task may hold, so the rows are numbered in a distributed way
    return tables.page(_t(spark, d, "lineitem"), ["l_extendedprice", "l_orderkey", "l_linenumber"],
                       offset=30_000, limit=80_000).select("l_orderkey", "l_linenumber", "l_extendedprice")


def q_nan_to_null(spark, d):
    e = _t(spark, d, "events")
    v = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return tables.nan_to_null(e.select("event_id", v.alias("value")))


def q_name_search(spark, d):
    return auditlog.search_by_name(_t(spark, d, "part"), "p_name", "ring", "p_brand", "Brand#2") \
        .select("p_partkey", "p_name", "p_brand")


def q_new_only(spark, d):
    batch = _t(spark, d, "part").select("p_partkey", "p_name")
    # parts never ordered in quantities above 45
    existing = (_t(spark, d, "lineitem").where(F.col("l_quantity") > 45)
                .select(F.col("l_partkey").alias("p_partkey")))
    return registry.new_only(batch, existing, ["p_partkey"])


def q_verify_append(spark, d):
    target = scratch_path(spark, "append")
    write_file(_t(spark, d, "orders"), "parquet", target, "overwrite")
    before = read_parquet(spark, target).count()
    # a good append, then one that lost rows on the way
    copy = perturbed_orders(spark, d)
    write_file(copy, "parquet", target, "append")
    good = verify.verify_append(before, copy, read_parquet(spark, target))
    got = good.collect()            # before the next append changes what is read
    middle = read_parquet(spark, target).count()
    write_file(lossy_copy(spark, d), "parquet", target, "append")
    got += verify.verify_append(middle, copy, read_parquet(spark, target)).collect()
    v = spark.createDataFrame(got, good.schema)
    return v.select("check_name", F.col("source").cast("bigint").alias("source"),
                    F.col("target").cast("bigint").alias("target"), "ok")


def lossy_copy(spark, d):
    """A copy that lost every hundredth order (a failed chunk)."""
    return _t(spark, d, "orders").where(F.col("o_orderkey") % 100 != 0)


def q_verify_messages(spark, d):
    v = verify.verification(_t(spark, d, "orders"), lossy_copy(spark, d), checks=["row_count"])
    return verify.failure_messages(v)


def q_copy_verify(spark, d):
    out = None
    for name in ("supplier", "documents"):
        for fmt in ("parquet", "csv"):
            _, ver = verify.copy_table(spark, {"type": "parquet", "path": f"{d}/{name}.parquet"},
                                       {"type": fmt, "path": scratch_path(spark, "copy"), "mode": "overwrite"})
            ver = ver.select(F.lit(name).alias("copied"), F.lit(fmt).alias("format"), "check_name", F.when(
                F.col("check_name") == "row_count", F.col("source")).cast("bigint").alias("rows"), "ok")
            out = ver if out is None else out.unionAll(ver)
    return out


def q_csv_splits(spark, d):
    # one file of whole documents, line breaks in its values, read by byte ranges
    docs, path = _t(spark, d, "documents"), scratch_path(spark, "documents-one-csv")
    export_table(docs, path, "csv", single=True)
    rows = read_csv(spark, path, schema=docs.schema, split_bytes=1 << 20)
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")


def q_csv_documents(spark, d):
    # whole documents: quotes, delimiters, line breaks and blanks survive the way through CSV
    docs, path = _t(spark, d, "documents"), scratch_path(spark, "documents-csv")
    export_table(docs, path, "csv")
    return read_csv(spark, path, schema=docs.schema).select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")


def q_file_query(spark, d):
    return read_source(spark, {"type": "parquet", "path": f"{d}/orders.parquet", "view": "o",
                               "query": "SELECT o_orderstatus, count(*) AS n FROM o GROUP BY o_orderstatus"})


def q_export_json(spark, d):
    src, path = _t(spark, d, "customer"), scratch_path(spark, "customer-json")
    export_table(src, path, "json")
    return read_json(spark, path, schema=src.schema).select("c_custkey", "c_name", "c_nationkey")


def q_export_json_array(spark, d):
    src, path = _t(spark, d, "customer"), scratch_path(spark, "customer-json-array")
    export_table(src.repartition(3), path, "json", lines=False)
    return read_json(spark, path, schema=src.schema, multiLine=True).select("c_custkey", "c_name", "c_nationkey")


def q_explore(spark, d):
    report = stats.explore(events_with_nulls(spark, d).select("event_id", "event_type", "value"))
    rows = [(report["total_rows"], r["summary"], str(r["event_type"]) if r.get("event_type") is not None else None,
             float(r["value"])) for r in report["summary"]]
    return spark.createDataFrame(rows, "total_rows bigint, summary string, event_type string, value double") \
        .select("total_rows", "summary", "event_type", _r("value").alias("value"))


def q_total_rows(spark, d):
    names = ("orders", "lineitem", "events", "documents")
    return spark.createDataFrame([(n, tables.total_rows(_t(spark, d, n))) for n in names], "name string, n bigint")


def q_pick_key(spark, d):
    # the key the rule picks tells the table's rows apart
    out = []
    for name, declared in (("nation", ["n_nationkey"]), ("customer", ["c_custkey"]), ("documents", None)):
        t = _t(spark, d, name)
        key = tables.pick_key(t.columns, declared, "sql" if declared else "clickhouse")
        out.append((name, key, t.select(key).distinct().count()))
    return spark.createDataFrame(out, "name string, picked string, n bigint")


def q_poll_increment(spark, d):
    # a key with many ties, taken a few rows at a time: every row arrives once
    out, state = scratch_path(spark, "poll-out"), scratch_path(spark, "poll-state")
    src = _t(spark, d, "events").withColumn("slot", F.floor(F.col("event_id") / 1700).cast("bigint"))
    poll_table(spark, lambda: src, "slot", out, state, max_rows=6000, available_now=True)
    return read_parquet(spark, out, recursiveFileLookup=True).select("event_id", "user_id", "event_type", "value")


def q_poll_stream(spark, d):
    # half of the table, then, after a restart, the rest: every row once
    src, out, ckpt = (scratch_path(spark, f"poll-stream-{x}") for x in ("in", "out", "ckpt"))
    events = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    late = F.col("event_id") % 1000 >= 500
    schema = events.schema
    for part in (events.where(~late).withColumn("seq", F.col("event_id")), events.where(late).withColumn("seq", F.col("event_id") + 10_000_000)):
        part.repartitionByRange(4, "seq").write.mode("append").parquet(src)
        poll_stream(spark, src, part.schema, "seq", out, ckpt, available_now=True)
    return read_parquet(spark, out).select(*schema.names)


def q_stream_dedup_ingest(spark, d):
    out, ckpt = scratch_path(spark, "dedup-out"), scratch_path(spark, "dedup-ckpt")
    stream = file_stream(spark, d, "parquet", _t(spark, d, "events").schema, pattern="events.parquet")
    dedup_ingest(stream, ["user_id", "event_type"], "ts", out, ckpt, delay="3650 days", available_now=True, close=True)
    return read_parquet(spark, out, recursiveFileLookup=True).select("user_id", "event_type")


def q_stream_first(spark, d):
    # the same rows, with NULL keys, in one, three and seven files: the same rows are kept
    events = _t(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), "event_type")
    day = F.dayofmonth("ts")
    out = None
    for files in (1, 3, 7):
        path, target, ckpt = (scratch_path(spark, f"first-{x}") for x in ("in", "out", "ckpt"))
        for i in range(files):
            events.where(F.floor((day - 1) * files / 31) == i).coalesce(1).write.mode("append").parquet(path)
        stream = file_stream(spark, path, "parquet", events.schema, max_files_per_trigger=1)
        dedup_ingest(stream, ["user_id", "event_type"], "ts", target, ckpt, delay="36 hours", lateness="1 hour", order=["event_id"],
                     available_now=True, close=True)
        rows = read_parquet(spark, target, recursiveFileLookup=True).select(F.lit(files).alias("files"), "event_id", "user_id", "event_type")
        out = rows if out is None else out.unionByName(rows)
    return out


def q_audit_append(spark, d):
    entries = auditlog.sanitize_details(
        auditlog.filter_log(log_from_events(spark, d), action="task_failed"))
    path = scratch_path(spark, "audit-log")
    auditlog.append_log(entries, path)
    auditlog.append_log(entries, path)
    return read_parquet(spark, path).select("id", "action", "resource", "details")


def q_spec_run(spark, d):
    target = scratch_path(spark, "spec-run")
    res = specs.run(spark, {
        "job_name": "orders_clean",
        "source": {"type": "parquet", "path": f"{d}/orders.parquet"},
        "operators": [{"type": "filter", "condition": "o_orderstatus = 'F'"},
                      {"type": "rename", "mapping": {"o_totalprice": "total"}},
                      {"type": "drop_na", "columns": ["total"]}],
        "target": {"type": "parquet", "path": target, "mode": "overwrite"}})
    return read_parquet(spark, target).select(
        "o_orderkey", "total", F.lit(res.rows_written).cast("bigint").alias("rows_written"))


def q_stream_dedup(spark, d):
    # watermark dedup on the event stream; the delay spans the whole month of
    # events, so every repeat of a (user, type) key is dropped
    schema = _t(spark, d, "events").schema
    stream = file_stream(spark, d, "parquet", schema, pattern="events.parquet")
    out, ckpt = scratch_path(spark, "stream-dedup"), scratch_path(spark, "stream-dedup-ckpt")
    ingest(stream, out, ckpt, available_now=True,
           transform=lambda s: dedup_stream(s, ["user_id", "event_type"], "ts", "60 days")
           .select("user_id", "event_type"))
    return read_parquet(spark, out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dedup_rows": q_dedup_rows,
    "dedup_key_latest": q_dedup_key_latest,
    "filter_sql": q_filter_sql,
    "fill_constant": q_fill_constant,
    "fill_subset": q_fill_subset,
    "fill_mean": _fill_stat("mean"),
    "fill_median": _fill_stat("median"),
    "fill_mode": _fill_stat("mode"),
    "drop_any": q_drop_any,
    "drop_subset": q_drop_subset,
    "rename_swap": q_rename_swap,
    "profile": q_profile,
    "outliers_iqr": q_outliers_iqr,
    "outliers_sequential": q_outliers_sequential,
    "outliers_approx": q_outliers_approx,
    "outliers_ranks": q_outliers_ranks,
    "standardize": q_standardize,
    "spec_chain": q_spec_chain,
    "verify_counts": q_verify_counts,
    "verify_checksum": q_verify_checksum,
    "verify_checksum_ok": q_verify_checksum_ok,
    "status": q_status,
    "verify_diff": q_verify_diff,
    "registry_upsert": q_registry_upsert,
    "registry_set": q_registry_set,
    "catalog_search": q_catalog_search,
    "asset_remove": q_asset_remove,
    "page": q_page,
    "page_rowid": q_page_rowid,
    "update_rows": q_update_rows,
    "delete_rows": q_delete_rows,
    "coerce": q_coerce,
    "structure": q_structure,
    "audit_page": q_audit_page,
    "audit_count": q_audit_count,
    "audit_delete": q_audit_delete,
    "audit_warning": q_audit_warning,
    "last_failure": q_last_failure,
    "duplicates": q_duplicates,
    "redact": q_redact,
    "truncate": q_truncate,
    "deleted_summary": q_deleted_summary,
    "csv_roundtrip": _roundtrip("csv"),
    "parquet_roundtrip": _roundtrip("parquet"),
    "json_roundtrip": _roundtrip("json"),
    "asset_scan": q_asset_scan,
    "object_copy": q_object_copy,
    "stream_ingest": q_stream_ingest,
    "dedup_key": q_dedup_key,
    "standardize_auto": q_standardize_auto,
    "page_after": q_page_after,
    "page_after_ties": q_page_after_ties,
    "page_deep": q_page_deep,
    "total_rows": q_total_rows,
    "pick_key": q_pick_key,
    "csv_documents": q_csv_documents,
    "file_query": q_file_query,
    "export_json": q_export_json,
    "explore": q_explore,
    "poll_increment": q_poll_increment,
    "stream_dedup_ingest": q_stream_dedup_ingest,
    "stream_first": q_stream_first,
    "poll_stream": q_poll_stream,
    "edit_files": q_edit_files,
    "csv_splits": q_csv_splits,
    "export_json_array": q_export_json_array,
    "nan_to_null": q_nan_to_null,
    "name_search": q_name_search,
    "new_only": q_new_only,
    "verify_append": q_verify_append,
    "verify_messages": q_verify_messages,
    "copy_verify": q_copy_verify,
    "audit_append": q_audit_append,
    "spec_run": q_spec_run,
    "stream_dedup": q_stream_dedup,
}
