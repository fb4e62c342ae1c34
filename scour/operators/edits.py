"""Edits that rewrite only the files they touch (T5, T6 on stored tables).

A stored table is a folder of Parquet files, a schema and manifests.  A manifest names the
files of one version; readers take the newest complete one.  An edit finds the files
that hold a wanted key, rewrites those and writes the next manifest, which swaps
the old files for the new ones at once.  All other files keep their name, time and
bytes, and older versions stay readable until ``drop_versions``.

The keys meet the table by a join of key and file name alone, so finding the files
reads one column of it; where files have narrow key ranges Spark skips most of them.  The
driver holds file names, as it does to read any table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import qcol
from ..session import delete_path, qualified
from .tables import _keys_frame, _require_key, delete_rows, update_rows

FILE = "__file"


@dataclass
class Edit:
    """What an edit did: rows that matched, files rewritten, files left alone, and the version it made (0 rows: none)."""

    rows: int
    rewritten: int
    untouched: int
    version: int


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a stored table, oldest first."""
    fs, p = _fs(spark, f"{path}/_manifests/v*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName()[1:]) for s in (fs.globStatus(p) or []))


def _files(spark: SparkSession, path: str, version: int) -> list[str]:
    return [r["file"] for r in spark.read.schema("file string").parquet(f"{path}/_manifests/v{version:09d}").collect()]


def _names(rows: DataFrame) -> list[str]:
    """The files that rows read from files come from."""
    # the column is URI-encoded, paths given to a reader are not
    return sorted(unquote(r[0]) for r in rows.select(F.col("_metadata.file_path").alias(FILE)).distinct().collect())


def _commit(spark: SparkSession, path: str, version: int, files: Sequence[str]) -> None:
    rows = spark.createDataFrame([(f,) for f in files], "file string")
    # two writers of one version: the second fails, its files are in no manifest
    rows.coalesce(1).write.mode("error").parquet(f"{path}/_manifests/v{version:09d}")


def store(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write ``df`` as a stored table (version 1), optionally in partition folders."""
    spark, root = df.sparkSession, qualified(df.sparkSession, path)
    if versions(spark, root):
        raise ValueError(f"{path} holds a stored table already")
    meta = spark.createDataFrame([(df.schema.json(), list(partition_by))], "schema string, partition_by array<string>")
    meta.coalesce(1).write.mode("overwrite").json(f"{root}/_table")
    _commit(spark, root, 1, _add(df, root, 1, partition_by))


def _table(spark: SparkSession, root: str) -> tuple[StructType, list[str]]:
    import json
    row = spark.read.schema("schema string, partition_by array<string>").json(f"{root}/_table").first()
    return StructType.fromJson(json.loads(row["schema"])), list(row["partition_by"])


def _add(df: DataFrame, root: str, version: int, partition_by: Sequence[str]) -> list[str]:
    """Write rows as files of a version; the names of those that hold any."""
    folder = f"{root}/data/v{version:09d}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(folder)
    fs, p = _fs(df.sparkSession, folder)
    if not any(s.getPath().getName()[0] not in "_." for s in fs.listStatus(p)):
        return []
    return _names(df.sparkSession.read.parquet(folder))


def _open(spark: SparkSession, root: str, files: Sequence[str], schema: StructType) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    by_version: dict[str, list[str]] = {}
    for f in files:
        base = f"{root}/data/" + f.split("/data/", 1)[1].split("/", 1)[0]
        by_version.setdefault(base, []).append(f)
    parts = [spark.read.schema(schema).option("basePath", base).parquet(*own).select(*[qcol(c) for c in schema.names], F.col("_metadata.file_path").alias(FILE))
             for base, own in sorted(by_version.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored table; the newest by default."""
    root = qualified(spark, path)
    have = versions(spark, root)
    if not have or version is not None and version not in have:
        raise ValueError(f"{path} has no {'stored table' if not have else f'version {version}'}")
    schema, _ = _table(spark, root)
    return _open(spark, root, _files(spark, root, version or have[-1]), schema).select(*[qcol(c) for c in schema.names])


def _rewrite(spark: SparkSession, path: str, keys: DataFrame, key: str, change) -> Edit:
    root = qualified(spark, path)
    have = versions(spark, root)
    if not have:
        raise ValueError(f"{path} has no stored table")
    schema, partition_by = _table(spark, root)
    files = _files(spark, root, have[-1])
    table = _open(spark, root, files, schema)
    _require_key(table, key)
    hits = (table.select(qcol(key), FILE).join(keys.select(qcol(key)).distinct(), key, "left_semi")
            .groupBy(FILE).agg(F.count("*").alias("n")).collect()) if files else []
    touched = {unquote(h[FILE]) for h in hits}
    if not touched:
        return Edit(0, 0, len(files), have[-1])
    stay = [f for f in files if f not in touched]
    rows = _open(spark, root, [f for f in files if f in touched], schema).select(*[qcol(c) for c in schema.names])
    version = have[-1] + 1
    new = _add(change(rows), root, version, partition_by)
    _commit(spark, root, version, [*stay, *new])
    return Edit(sum(h["n"] for h in hits), len(touched), len(stay), version)


def delete_stored(spark: SparkSession, path: str, keys, key: str) -> Edit:
    """Delete the rows with one of ``keys`` (a DataFrame or a list) from a stored table (T5)."""
    schema, _ = _table(spark, qualified(spark, path))
    wanted = _keys_frame(spark.createDataFrame([], schema), keys, key)
    return _rewrite(spark, path, wanted, key, lambda rows: delete_rows(rows, wanted, key))


def update_stored(spark: SparkSession, path: str, changes: DataFrame, key: str, **options) -> Edit:
    """Set the changed columns on the rows whose key is among ``changes`` in a stored table (T6); see ``update_rows``."""
    if key not in changes.columns:
        raise ValueError(f"changes need the key column {key!r}")
    return _rewrite(spark, path, changes, key, lambda rows: update_rows(rows, changes, key, **options))


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions and the files only they name; how many files went."""
    root = qualified(spark, path)
    have = versions(spark, root)
    old, stay = have[:-keep] if keep else have, have[-keep:] if keep else []
    if not stay:
        raise ValueError("a stored table keeps one version at least")
    kept = {f for v in stay for f in _files(spark, root, v)}
    gone = {f for v in old for f in _files(spark, root, v)} - kept
    for v in old:
        delete_path(spark, f"{root}/_manifests/v{v:09d}")
    for f in sorted(gone):
        delete_path(spark, f)
    return len(gone)
