"""JDBC sinks (K3-K7).

Executors write their partitions in parallel batches; ``num_partitions`` caps
the number of concurrent connections so a 1000-executor job does not open
1000 connections to one database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, FloatType, DoubleType, IntegralType, StructType

from ..functions.columns import qcol, quote
from ..sources.jdbc import CHUNK_ROWS, DRIVERS, url_from_connection
from .files import check_mode

# --- fixed values: must equal the reference's behaviour -----------------------
# ClickHouse column types for a table created from a DataFrame: integers ->
# Int64, floating point -> Float64, anything else -> String; engine MergeTree
# ordered by the empty tuple.  Spark creates a table from its own types, so the
# columns are cast to the Spark types that ClickHouse stores as those.
CLICKHOUSE_INT = "bigint"
CLICKHOUSE_FLOAT = "double"
CLICKHOUSE_OTHER = "string"
CLICKHOUSE_ENGINE = "ENGINE = MergeTree() ORDER BY tuple()"
SYSTEM_ALIASES = {"system_mysql": "mysql", "system_clickhouse": "clickhouse"}
# ------------------------------------------------------------------------------


def clickhouse_type(dt: DataType) -> str:
    if isinstance(dt, IntegralType):
        return CLICKHOUSE_INT
    if isinstance(dt, (FloatType, DoubleType)):
        return CLICKHOUSE_FLOAT
    return CLICKHOUSE_OTHER


def clickhouse_ddl(schema: StructType) -> str:
    """The DDL (Spark type names) of the table a ClickHouse target gets (K4)."""
    return ", ".join(f"{quote(f.name)} {clickhouse_type(f.dataType)}" for f in schema.fields)


def clickhouse_frame(df: DataFrame) -> DataFrame:
    """The DataFrame with the column types of a ClickHouse target."""
    return df.select(*[qcol(f.name).cast(clickhouse_type(f.dataType)).alias(f.name) for f in df.schema.fields])


def resolve_target(target: dict, connections: dict | None = None) -> tuple[str, str, dict]:
    """Map ``system_mysql`` / ``system_clickhouse`` to a named connection (K7).

    Returns (kind, url, options).  Connections come from the caller, never
    from the environment.
    """
    kind = target["type"]
    conns = connections or {}
    conn = dict(conns.get(kind, {})) if kind in SYSTEM_ALIASES else {}
    conn.update(target.get("connection_info") or {})
    kind = SYSTEM_ALIASES.get(kind, kind)
    url = target.get("url") or conn.get("url")
    if not url:
        if kind == "jdbc" or "host" not in conn:
            raise ValueError(f"{target['type']} target needs 'url' or connection details")
        url = url_from_connection(kind, conn)
    if "clickhouse" in url:
        kind = "clickhouse"
    elif "mysql" in url:
        kind = "mysql"
    opts = {k: conn[k] for k in ("user", "password") if k in conn}
    return kind, url, opts


def write_steps(mode: str, truncate: bool, create_like_source: bool) -> list[tuple[bool, str, bool]]:
    """The writes a request amounts to: (with rows, mode, truncate) each.

    Creating like the source is a write of no rows that leaves an existing
    table alone; an overwrite after it empties the table and keeps its
    structure, and never turns into an append.
    """
    mode = check_mode(mode)
    if not create_like_source:
        return [(True, mode, truncate)]
    if mode in ("error", "errorifexists", "ignore"):
        return [(True, mode, truncate)]     # creating the table is all these do
    return [(False, "ignore", False), (True, mode, truncate or mode == "overwrite")]


def write_jdbc(df: DataFrame, url: str, table: str, mode: str, *, kind: str | None = None,
               truncate: bool = False, create_like_source: bool = False,
               num_partitions: int | None = None, batchsize: int = CHUNK_ROWS,
               **options) -> None:
    """Append or overwrite a database table (K3-K6).

    ``truncate=True`` with overwrite empties the table and keeps its structure
    (K5).  ``create_like_source=True`` first creates the target from the
    DataFrame's structure with zero rows, if it is missing (K6).  ClickHouse
    targets get the type mapping above (K4).
    """
    opts = {"url": url, "dbtable": table, "batchsize": str(batchsize)}
    kind = kind or (url.split(":")[1] if url.startswith("jdbc:") else None)
    if kind in DRIVERS:
        opts["driver"] = DRIVERS[kind]
    if kind == "clickhouse":
        opts["createTableOptions"] = CLICKHOUSE_ENGINE
        df = clickhouse_frame(df)
    if num_partitions:
        opts["numPartitions"] = str(num_partitions)
    opts.update({k: str(v) for k, v in options.items()})
    for rows, step, empty in write_steps(mode, truncate, create_like_source):
        out = df if rows else df.limit(0)
        out.write.format("jdbc").options(**opts, **({"truncate": "true"} if empty else {})).mode(step).save()
