"""Table management: paging, keyed updates and deletes, coercion, structure.

Edits are expressed as joins that produce a new DataFrame; the caller writes
it (to a new path: a table being read must not be overwritten in place).
Joins are left to Catalyst and AQE: the change set is broadcast when it is
small at run time, otherwise both sides shuffle on the key, and AQE splits a
key that holds a large share of the target.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from ..functions.coerce import coerce_text, parse_type, rejected
from ..functions.columns import field_types, is_fractional, qcol, quote
from ..session import scratch_path
from .cleaning import OrderSpec, _order_columns

ROWID = "_rowid"
NUMBER = "__number"
SHALLOW = 100_000          # rows up to the end of a page that a task may hold


# -- T1 / T2 / T3: pages --------------------------------------------------------------

def page(df: DataFrame, order_by: OrderSpec, offset: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``offset .. offset+limit`` in a total order.

    The order is required: without one a page is not reproducible.  A page
    that ends within ``SHALLOW`` rows is a per-task top-(offset+limit) and a
    merge; a deeper one is cut out of a distributed numbering of the rows, so no
    task ever holds the rows before it.  For walking a table use ``page_after``.
    """
    if not order_by:
        raise ValueError("page needs order_by: a page without an order is not reproducible")
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must be >= 0")
    order = _order_columns(order_by)
    if offset + limit <= SHALLOW:
        return df.orderBy(*order).offset(offset).limit(limit)
    n = F.col(NUMBER)
    return (number_rows(df, order).where((n >= offset) & (n < offset + limit)).orderBy(n).drop(NUMBER))


def number_rows(df: DataFrame, order: Sequence[Column], name: str = NUMBER) -> DataFrame:
    """Add the row's place (from 0) in a total order, without one task seeing all rows.

    Rows are range-partitioned, sorted and written with their place in the
    partition; the partitions' sizes, one number each, give where it starts.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "numbered")
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .select("*", part.alias("__part"), place.alias("__place")).write.parquet(path))
    rows = spark.read.parquet(path)
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    start = rows.groupBy("__part").count().select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    # one row a partition of the shuffle
    placed = rows.join(F.broadcast(start), "__part").withColumn(name, F.col("__place") + F.col("__start"))
    return placed.drop("__part", "__place", "__start")


def page_after(df: DataFrame, key: str | Sequence[str], after=None, limit: int = 100,
               descending: bool = False) -> DataFrame:
    """Keyset page: the ``limit`` rows following the key values ``after`` (T1 at depth).

    ``key`` is one column or several that together tell all rows apart (a
    non-unique column needs a tie-break behind it, or rows that tie at a page's
    end would be skipped); ``after`` has one value per column, as the last row
    of the page before.  NULLs come last in either direction.  The predicate on
    the first column reaches the scan, and the top-k stays per task, however
    deep the page.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if after is not None:
        last = list(after) if isinstance(after, (tuple, list)) else [after]
        if len(last) != len(keys):
            raise ValueError(f"after needs one value for each of {keys}")
        df = df.where(_follows([qcol(k) for k in keys], last, descending))
    order = [qcol(k).desc_nulls_last() if descending else qcol(k).asc_nulls_last() for k in keys]
    return df.orderBy(*order).limit(limit)


def _follows(cols: list[Column], last: list, descending: bool) -> Column:
    """Rows behind ``last`` in the order of ``cols``, NULLs last."""
    c, v = cols[0], last[0]
    later = F.lit(False) if v is None else ((c < F.lit(v) if descending else c > F.lit(v)) | c.isNull())
    if len(cols) == 1:
        return later
    here = c.isNull() if v is None else c == F.lit(v)
    # implied by the rest, and a plain range that the scan can use
    out = later | (here & _follows(cols[1:], last[1:], descending))
    return out if v is None else ((c <= F.lit(v) if descending else c >= F.lit(v)) | c.isNull()) & out


def total_rows(df: DataFrame) -> int:
    """Row count (T2); Parquet answers it from footers."""
    return df.count()


def with_rowid(page_df: DataFrame, order_by: OrderSpec, *, key: str | None = None,
               offset: int = 0) -> DataFrame:
    """Add ``_rowid``: the key value if there is a key, else ``offset + index``.

    The index is computed over the page only (at most ``limit`` rows), which is
    what a row id of a page means.
    """
    if key is not None:
        return page_df.withColumn(ROWID, qcol(key).cast("string"))
    w = Window.orderBy(*_order_columns(order_by))
    return page_df.withColumn(ROWID, (F.lit(offset) + F.row_number().over(w) - 1).cast("string"))


# -- T4: key choice ------------------------------------------------------------------------

def pick_key(columns: Sequence[str], primary_key: Sequence[str] | None = None,
             dialect: str = "sql") -> str | None:
    """The column that addresses rows (T4).

    A column called ``id`` serves both dialects.  In a SQL database a declared
    primary key goes before it, and a table with neither cannot be edited
    (None); a ClickHouse table falls back to the column it starts with.
    """
    if not columns:
        raise ValueError("a table without columns has no key")
    declared = list(primary_key or ()) if dialect != "clickhouse" else []
    fallback = columns[0] if dialect == "clickhouse" else None
    return next(iter(declared), "id" if "id" in columns else fallback)


def _require_key(df: DataFrame, key: str | None) -> str:
    if key is None:
        raise ValueError("no key column is known for this table; pass key=")
    if key not in df.columns:
        raise ValueError(f"key column {key!r} not in table")
    return key


def _keys_frame(df: DataFrame, keys, key: str) -> DataFrame:
    """Keys as a one-column DataFrame; literal lists are cast to the key type."""
    if isinstance(keys, DataFrame):
        src = key if key in keys.columns else keys.columns[0]
        return keys.select(qcol(src).alias(key))
    dt = field_types(df)[key]
    vals = list(keys)
    text = any(isinstance(v, str) for v in vals)
    schema = StructType([StructField(key, StringType() if text else dt, True)])
    lit_df = df.sparkSession.createDataFrame([(v,) for v in vals], schema)
    return lit_df.select(qcol(key).cast(dt).alias(key))


# -- T5: delete by key -----------------------------------------------------------------------

def delete_rows(df: DataFrame, keys, key: str | None) -> DataFrame:
    """Rows whose key is not in ``keys`` (T5): a left anti join."""
    key = _require_key(df, key)
    kept = df.join(_keys_frame(df, keys, key), on=key, how="left_anti")
    return kept.select(*[qcol(c) for c in df.columns])      # a join puts its key first


def count_matches(df: DataFrame, keys, key: str | None) -> int:
    """How many rows a delete or update would touch (0 means "not found")."""
    key = _require_key(df, key)
    return df.join(_keys_frame(df, keys, key), on=key, how="left_semi").count()


# -- T6: update by key -------------------------------------------------------------------------

def update_rows(df: DataFrame, changes: DataFrame, key: str | None, *,
                coerce: bool = False, check_unique: bool = True) -> DataFrame:
    """Set the changed columns on every row whose key matches.

    ``changes`` holds the key and new values; its key column and columns the
    table does not have are ignored, so a change set with nothing else is a
    no-op.  ``coerce=True`` parses text values into the column types (T7).
    Keys must be unique in ``changes`` (checked with one small job unless
    ``check_unique=False``).
    """
    key = _require_key(df, key)
    if key not in changes.columns:
        raise ValueError(f"changes need the key column {key!r}")
    types = field_types(df)
    cols = [c for c in changes.columns if c != key and c != ROWID and c in types]
    if not cols:
        return df
    if check_unique:
        dup = changes.groupBy(qcol(key)).count().where(F.col("count") > 1).limit(1).count()
        if dup:
            raise ValueError(f"changes hold the same {key!r} more than once")
    new = [(coerce_text(qcol(c).cast("string"), types[c]) if coerce else qcol(c).cast(types[c]))
           .alias(f"__new_{i}") for i, c in enumerate(cols)]
    ch = changes.select(qcol(key).alias(key), F.lit(True).alias("__hit"), *new)
    j = df.join(ch, on=key, how="left")
    pos = {c: i for i, c in enumerate(cols)}
    out = []
    for c in df.columns:
        if c in pos:
            out.append(F.when(F.col("__hit"), F.col(f"__new_{pos[c]}"))
                       .otherwise(qcol(c)).alias(c))
        else:
            out.append(qcol(c))
    return j.select(*out)


# -- T7: coercion ---------------------------------------------------------------------------------

def coerce_columns(df: DataFrame, types: Mapping[str, DataType | str]) -> DataFrame:
    """Parse text columns into types; add ``<column>_rejected`` flags.

    Types are Spark types, or names of Spark or ClickHouse types.
    """
    out, flags = [], []
    for c in df.columns:
        if c in types:
            t = types[c]
            dt = parse_type(t) if isinstance(t, str) else t
            raw = qcol(c).cast("string")
            val = coerce_text(raw, dt)
            out.append(val.alias(c))
            flags.append(rejected(raw, val).alias(f"{c}_rejected"))
        else:
            out.append(qcol(c))
    unknown = set(types) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown column(s) {sorted(unknown)}")
    return df.select(*out, *flags)


# -- T8: structure -----------------------------------------------------------------------------

def structure(df: DataFrame) -> DataFrame:
    """(position, name, type, nullable) per column (T8); bounded by the column count."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable)
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, type string, nullable boolean")


# -- T9: NaN as NULL for display ------------------------------------------------------------

def nan_to_null(df: DataFrame) -> DataFrame:
    types = field_types(df)
    return df.select(*[F.nanvl(qcol(c), F.lit(None).cast(types[c])).alias(c)
                       if is_fractional(types[c]) else qcol(c) for c in df.columns])


__all__ = ["ROWID", "coerce_columns", "count_matches", "delete_rows", "nan_to_null", "number_rows",
           "page", "page_after", "pick_key", "quote", "structure", "total_rows", "update_rows",
           "with_rowid"]
