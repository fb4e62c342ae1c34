"""File sinks.

The write mode is a required argument: the reference defaulted to overwrite in
one path and append in another, which is how data gets lost.  Writes are
parallel (one part file per task); ``partition_by`` lays out Hive-style folders
so later reads prune partitions.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol

# the functions tasks run travel with the job: executors need not have this package
register_pickle_by_value(sys.modules[__name__])

WRITE_MODES = ("append", "overwrite", "error", "errorifexists", "ignore")


def check_mode(mode: str) -> str:
    if mode not in WRITE_MODES:
        raise ValueError(f"write mode must be one of {WRITE_MODES}, got {mode!r}")
    return mode


def write_file(df: DataFrame, fmt: str, path: str, mode: str, *,
               partition_by: Sequence[str] | None = None, **options) -> None:
    """Write CSV (with header), Parquet or JSON Lines (K1, K2, K9)."""
    w = df.write.mode(check_mode(mode))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # quotes are doubled as other tools expect, and blanks at the ends of a value stay
        w.options(**{"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
                     "ignoreTrailingWhiteSpace": False, **options}).csv(path)
    elif fmt == "parquet":
        w.options(**options).parquet(path)
    elif fmt == "json":
        w.options(**options).json(path)
    else:
        raise ValueError(f"unsupported file format {fmt!r}; use csv, parquet or json")


def export_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", *, lines: bool = True,
                 single: bool = False) -> None:
    """Export as CSV with a header or as JSON records (K9).

    ``lines``: one record per line.  ``lines=False`` writes JSON arrays: each file holds one array of its task's
    records, with NULLs spelled out; ``single`` makes that one file (and one task: for exports that a person reads).
    """
    if fmt not in ("csv", "json"):
        raise ValueError("export format must be 'csv' or 'json'")
    if single:
        df = df.coalesce(1)
    if fmt == "csv" or lines:
        write_file(df, fmt, path, mode)
        return
    records = df.select(F.to_json(F.struct(*[qcol(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    def bracket(batches):
        import pyarrow as pa
        begun = False
        for b in batches:
            if b.num_rows:
                rows = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([("," if begun or i else "[") + r for i, r in enumerate(rows)], pa.string())], ["value"])
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"], pa.string())], ["value"])

    records.mapInArrow(bracket, "value string").write.mode(check_mode(mode)).text(path)
