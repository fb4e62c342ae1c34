"""JDBC sources.

One reader for MySQL, ClickHouse and any JDBC URL.  At scale a single JDBC
connection is the bottleneck, so a numeric ``partition_column`` splits the read
into ``num_partitions`` range queries run by the executors; the bounds are read
from the database (one tiny query) when not given.  ``fetchsize`` replaces the
reference's 5000-row chunk loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: must equal the reference's behaviour -----------------------
CHUNK_ROWS = 5000            # rows per fetch (the reference's sync chunk size)
DEFAULT_PORTS = {"mysql": 3306, "clickhouse": 8123}
# ------------------------------------------------------------------------------

DRIVERS = {"mysql": "com.mysql.cj.jdbc.Driver",
           "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver"}


def jdbc_url(kind: str, host: str, port: int | None = None, database: str | None = None) -> str:
    """``jdbc:<kind>://host:port/database`` for mysql or clickhouse."""
    if kind not in DEFAULT_PORTS:
        raise ValueError(f"unknown database kind {kind!r}; give a full JDBC url instead")
    port = port or DEFAULT_PORTS[kind]
    url = f"jdbc:{kind}://{host}:{port}"
    if database:
        url += f"/{database}"
    elif kind == "clickhouse":
        url += "/default"
    return url


def url_from_connection(kind: str, conn: dict) -> str:
    """URL from a connection record ``{host, port, database, ...}``."""
    return jdbc_url(kind, conn["host"], conn.get("port"), conn.get("database"))


def jdbc_options(url: str, *, table: str | None = None, query: str | None = None,
                 user: str | None = None, password: str | None = None,
                 driver: str | None = None, fetchsize: int = CHUNK_ROWS,
                 partition_column: str | None = None, lower_bound=None, upper_bound=None,
                 num_partitions: int | None = None, **extra) -> dict[str, str]:
    """Reader options; exactly one of ``table`` / ``query``."""
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table= or query=")
    opts = {"url": url, "fetchsize": str(fetchsize)}
    if table is not None:
        opts["dbtable"] = table
    else:
        opts["query"] = query
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    kind = url.split(":")[1] if url.startswith("jdbc:") else None
    drv = driver or DRIVERS.get(kind)
    if drv:
        opts["driver"] = drv
    if partition_column:
        if table is None:
            raise ValueError("partitioned reads need table=, not query= (Spark rule)")
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_jdbc(spark: SparkSession, url: str, *, table: str | None = None,
              query: str | None = None, partition_column: str | None = None,
              num_partitions: int | None = None, lower_bound=None, upper_bound=None,
              **options) -> DataFrame:
    """Read a table or a query through JDBC; filters and limits are pushed down.

    With ``partition_column`` and no bounds, ``min``/``max`` are read first
    with one aggregate query run by the database.
    """
    if partition_column and (lower_bound is None or upper_bound is None):
        base = {k: v for k, v in jdbc_options(url, table=table, **options).items()
                if k not in ("dbtable",)}
        base["query"] = f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}"
        row = spark.read.format("jdbc").options(**base).load().first()
        lower_bound, upper_bound = row["lo"], row["hi"]
        if lower_bound is None:
            partition_column = None
    opts = jdbc_options(url, table=table, query=query,
                        partition_column=partition_column, num_partitions=num_partitions,
                        lower_bound=lower_bound, upper_bound=upper_bound, **options)
    return spark.read.format("jdbc").options(**opts).load()


def list_tables(spark: SparkSession, url: str, schema: str | None = None, **options) -> DataFrame:
    """Tables of a database from its catalog view."""
    where = f" WHERE table_schema = '{_sql_text(schema)}'" if schema else ""
    sql = f"SELECT table_schema, table_name FROM information_schema.tables{where}"
    return read_jdbc(spark, url, query=sql, **options)


def _sql_text(s: str) -> str:
    return s.replace("'", "''")
