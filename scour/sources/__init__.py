"""Readers: files (CSV, Parquet, JSON Lines), JDBC databases, object listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .files import (list_objects, query_files, read_csv, read_file, read_json,
                    read_parquet, scan_data_dir)
from .jdbc import jdbc_options, jdbc_url, list_tables, read_jdbc, url_from_connection

SOURCE_TYPES = ("csv", "parquet", "json", "jdbc", "mysql", "clickhouse", "table")


def read_source(spark: SparkSession, source: dict, connections: dict | None = None) -> DataFrame:
    """Open the source of a spec: ``{type, path | table | query | url, options?}``.

    ``query`` is honoured for every type: for files it runs over a temp view
    named ``source`` (or the given ``view``).
    """
    if not isinstance(source, dict) or "type" not in source:
        raise ValueError("source needs a 'type' (one of %s)" % (SOURCE_TYPES,))
    kind = source["type"]
    opts = dict(source.get("options") or {})
    if kind in ("csv", "parquet", "json"):
        if "path" not in source:
            raise ValueError(f"{kind} source needs 'path'")
        df = read_file(spark, kind, source["path"], **opts)
        if source.get("query"):
            return query_files(spark, {source.get("view", "source"): df}, source["query"])
        return df
    if kind == "table":
        return spark.table(source["table"])
    if kind in ("jdbc", "mysql", "clickhouse"):
        conn = dict((connections or {}).get(source.get("connection"), {}))
        conn.update(source.get("connection_info") or {})
        url = source.get("url") or (url_from_connection(kind, conn) if kind != "jdbc" else None)
        if not url:
            raise ValueError(f"{kind} source needs 'url' or connection details")
        for k in ("user", "password"):
            if k in conn and k not in opts:
                opts[k] = conn[k]
        return read_jdbc(spark, url, table=None if source.get("query") else source.get("table"),
                         query=source.get("query"), **opts)
    raise ValueError(f"unsupported source type {kind!r}; use one of {SOURCE_TYPES}")


__all__ = ["SOURCE_TYPES", "jdbc_options", "jdbc_url", "list_objects", "list_tables",
           "query_files", "read_csv", "read_file", "read_jdbc", "read_json", "read_parquet",
           "read_source", "scan_data_dir", "url_from_connection"]
