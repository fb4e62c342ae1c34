"""Asset registry and catalog.

The registry is a table ``(id, table_name, source_type, source_name,
row_count, created_at, updated_at)``.  An upsert is a full outer join of the
registry with a batch of new facts, i.e. MERGE semantics written as one plan;
the caller writes the result to a new version of the registry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import qcol
from .tables import number_rows, page

REGISTRY_SCHEMA = ("id bigint, table_name string, source_type string, source_name string, "
                   "row_count bigint, created_at timestamp, updated_at timestamp")

# --- fixed values: must equal the reference's behaviour -----------------------
# Sync keeps one registry namespace per storage class: object buckets and
# ClickHouse have their own, every other database type shares one.
OWN_CLASS_TYPES = ("minio", "clickhouse")
SHARED_CLASS = "db"
BUCKET_TYPE = "minio"      # registry type shown as a bucket in the catalog
# ------------------------------------------------------------------------------


def type_class(source_type: Column) -> Column:
    return F.when(source_type.isin(*OWN_CLASS_TYPES), source_type).otherwise(F.lit(SHARED_CLASS))


def upsert_registry(registry: DataFrame, batch: DataFrame, *, mode: str = "set",
                    match_class: bool = True, now: Column | None = None) -> DataFrame:
    """Merge ``batch (table_name, source_type, source_name, row_count)`` into the registry.

    ``mode="set"`` replaces ``row_count`` (overwrite, V8); ``mode="add"`` adds
    to it (append, V7).  ``match_class=True`` matches on (table_name, storage
    class) as a sync does, updating ``source_type``/``source_name`` too;
    ``False`` matches the exact (table_name, source_type) as a preprocess job
    does.  New entries get ids after the current maximum, in name order.

    One entry per key: batch rows that share a key are one fact (``add`` sums
    their counts, ``set`` takes the largest; type and source are those of the
    largest count), and of several entries of a key the oldest (smallest id) is
    the one that is changed.
    """
    if mode not in ("set", "add"):
        raise ValueError("mode must be 'set' or 'add'")
    now = now if now is not None else F.current_timestamp()
    match = type_class if match_class else (lambda c: c)
    # only the oldest entry of a key can be hit: the others get no key to join on
    oldest = Window.partitionBy("table_name", match(F.col("source_type"))).orderBy("id")
    reg = registry.withColumn("__m", F.when(F.row_number().over(oldest) == 1, match(F.col("source_type"))))
    largest = F.max(F.struct(F.coalesce("row_count", F.lit(0)).alias("n"), "source_type", "source_name"))
    b = (batch.groupBy(F.col("table_name").alias("__bn"), match(F.col("source_type")).alias("__bm"))
         .agg((F.sum("row_count") if mode == "add" else F.max("row_count")).alias("__br"), largest.alias("__l"))
         .select("__bn", "__bm", "__br", F.col("__l.source_type").alias("__bt"), F.col("__l.source_name").alias("__bs")))
    j = reg.join(b, (reg["table_name"] == b["__bn"]) & (reg["__m"] == b["__bm"]), "full_outer")
    hit, fresh = F.col("id").isNotNull() & F.col("__bn").isNotNull(), F.col("id").isNull()
    rows = F.when(F.lit(mode == "add") & hit, F.col("row_count") + F.col("__br")) \
            .when(F.col("__bn").isNotNull(), F.col("__br")).otherwise(F.col("row_count"))
    keep_type = F.col("source_type") if not match_class else F.coalesce("__bt", "source_type")
    keep_src = F.col("source_name") if not match_class else F.coalesce("__bs", "source_name")
    merged = j.select(
        F.col("id"),
        F.coalesce("table_name", "__bn").alias("table_name"),
        F.when(fresh, F.col("__bt")).otherwise(keep_type).alias("source_type"),
        F.when(fresh, F.col("__bs")).otherwise(keep_src).alias("source_name"),
        rows.cast("bigint").alias("row_count"),
        F.when(fresh, now).otherwise(F.col("created_at")).cast("timestamp").alias("created_at"),
        F.when(F.col("__bn").isNotNull(), now).otherwise(F.col("updated_at"))
         .cast("timestamp").alias("updated_at"))
    top = registry.agg(F.max("id")).first()[0] or 0      # one number
    old = merged.where(F.col("id").isNotNull())
    new = number_rows(merged.where(F.col("id").isNull()).drop("id"),
                      [F.col("table_name").asc(), F.col("source_type").asc()], "__n")
    return old.unionByName(new.withColumn("id", F.lit(top + 1) + F.col("__n")).select(*old.columns))


def catalog(files: DataFrame | None, registry: DataFrame) -> DataFrame:
    """Files and registered tables as one asset list.

    Columns: id, name, type (file / table / bucket), path, size, source, rows.
    """
    reg = registry.select(
        F.col("id"), F.col("table_name").alias("name"),
        F.when(F.col("source_type") == BUCKET_TYPE, F.lit("bucket"))
         .otherwise(F.lit("table")).alias("type"),
        F.col("table_name").alias("path"), F.lit("-").alias("size"),
        F.col("source_type").alias("source"), F.col("row_count").alias("rows"))
    if files is None:
        return reg
    fs = files.select(F.lit(None).cast("bigint").alias("id"), "name", F.lit("file").alias("type"),
                      "path", F.format_string("%.2f KB", F.col("size_kb")).alias("size"),
                      F.col("source"), F.lit(0).cast("bigint").alias("rows"))
    return fs.unionByName(reg)


def search_assets(assets: DataFrame, query: str | None = None, asset_type: str | None = None,
                  *, order_by: Sequence[str] = ("name", "type", "path"),
                  offset: int = 0, limit: int | None = None) -> DataFrame:
    """Case-insensitive name search and type filter, then a page."""
    df = assets
    if query:
        df = df.where(F.lower(F.col("name")).contains(query.lower()))
    if asset_type and asset_type != "all":
        df = df.where(F.col("type") == asset_type)
    if limit is None:
        return df
    return page(df, list(order_by), offset, limit)


def remove_assets(registry: DataFrame, *, ids: Sequence[int] = (), names: Sequence[str] = ()
                  ) -> DataFrame:
    """Drop registry entries by id or by table name."""
    spark = registry.sparkSession
    out = registry
    if ids:
        out = out.join(spark.createDataFrame([(int(i),) for i in ids], "id bigint"), "id", "left_anti")
    if names:
        out = out.join(spark.createDataFrame([(n,) for n in names], "table_name string"),
                       "table_name", "left_anti")
    return out.select(*registry.columns)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once, with their count."""
    return (df.groupBy(*[qcol(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def new_only(batch: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not already present (A6 for incoming rows)."""
    # an anti join needs no distinct keys: duplicates on the right change nothing
    return batch.join(existing.select(*[qcol(k) for k in keys]), list(keys), "left_anti")
