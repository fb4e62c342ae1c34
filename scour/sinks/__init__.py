"""Writers: files, JDBC databases, object stores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .files import WRITE_MODES, check_mode, export_table, write_file
from .jdbc import clickhouse_ddl, clickhouse_frame, resolve_target, write_jdbc
from .objects import copy_objects, object_digests, verify_copy

TARGET_TYPES = ("csv", "parquet", "json", "table", "jdbc", "mysql", "clickhouse",
                "system_mysql", "system_clickhouse")


def write_target(df: DataFrame, target: dict, connections: dict | None = None) -> None:
    """Write to the target of a spec: ``{type, path | table, mode, ...}``."""
    if not isinstance(target, dict) or "type" not in target:
        raise ValueError("target needs a 'type' (one of %s)" % (TARGET_TYPES,))
    if "mode" not in target:
        raise ValueError("target needs an explicit 'mode' (append or overwrite)")
    kind, mode = target["type"], target["mode"]
    opts = dict(target.get("options") or {})
    if kind in ("csv", "parquet", "json"):
        if "path" not in target:
            raise ValueError(f"{kind} target needs 'path'")
        write_file(df, kind, target["path"], mode,
                   partition_by=target.get("partition_by"), **opts)
    elif kind == "table":
        df.write.mode(check_mode(mode)).saveAsTable(target["table"])
    elif kind in ("jdbc", "mysql", "clickhouse", "system_mysql", "system_clickhouse"):
        db_kind, url, conn_opts = resolve_target(target, connections)
        conn_opts.update(opts)
        write_jdbc(df, url, target["table"], mode, kind=db_kind,
                   truncate=bool(target.get("truncate")),
                   create_like_source=bool(target.get("create_like_source")), **conn_opts)
    else:
        raise ValueError(f"unsupported target type {kind!r}; use one of {TARGET_TYPES}")


__all__ = ["TARGET_TYPES", "WRITE_MODES", "check_mode", "clickhouse_ddl", "clickhouse_frame",
           "copy_objects", "export_table", "object_digests", "resolve_target", "verify_copy",
           "write_file", "write_jdbc", "write_target"]
