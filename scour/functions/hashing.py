"""Order-independent content checksums (V3).

A table checksum is the sum of a per-row hash, so it does not depend on row
order or partitioning and is computed with one partial aggregate per task.
Sums are kept as DECIMAL(38,0): a trillion rows of 64-bit hashes fit, a LONG
sum would overflow (and raise under ANSI mode).
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import qcol

SUM_TYPE = "decimal(38,0)"


def row_text(columns: list[str], null_safe: bool = True, blank_null: Collection[str] = ()) -> Column:
    """Text image of a row; in the columns ``blank_null`` the empty string is NULL.

    ``null_safe=False`` reproduces ``CONCAT_WS(',', …)``, which skips NULLs, so
    ``(a, NULL, b)`` and ``(a, b, NULL)`` give the same text.  The null-safe
    form writes each field as ``<length>:<text>`` and NULL as ``N``, which
    decodes in only one way; it stays in generated code (``to_json`` does not).
    """
    as_text = [F.nullif(qcol(c), F.lit("")) if c in blank_null else qcol(c).cast("string") for c in columns]
    if null_safe:
        return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("N"))
                          for t in as_text])
    return F.concat_ws(",", *as_text)


def row_hash(columns: list[str], null_safe: bool = True, algorithm: str = "crc32",
             blank_null: Collection[str] = ()) -> Column:
    text = row_text(columns, null_safe, blank_null)
    if algorithm == "crc32":
        return F.crc32(text)
    if algorithm == "xxhash64":
        return F.xxhash64(text)
    raise ValueError(f"unknown checksum algorithm {algorithm!r}; use crc32 or xxhash64")


def checksum(columns: list[str], null_safe: bool = True, algorithm: str = "crc32") -> Column:
    """Aggregate: sum of row hashes as DECIMAL(38,0)."""
    return F.sum(row_hash(columns, null_safe, algorithm).cast(SUM_TYPE))
