"""Copying and verifying tables (V1-V6, V9, digest compare of V4).

Verification never joins the two tables row by row: both sides are unioned
with a side tag and reduced by one aggregate (counts and order-free
checksums), so each check costs one scan of each side and a partial
aggregate.  The row-level difference groups the union by all columns once
(one shuffle, hot duplicate rows collapse map-side) instead of running
``exceptAll`` in both directions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DataType, DecimalType, DoubleType, IntegralType, LongType, MapType, StringType,
                               StructType)

from ..functions.columns import field_types, is_fractional, is_numeric, qcol
from ..functions.hashing import SUM_TYPE, row_hash
from ..sinks import write_target
from ..sources import read_source

CHECKS = ("row_count", "checksum")
BUCKETS = 1 << 16          # hash buckets that a row diff compares by digest first


def _aligned(source: DataFrame, target: DataFrame, columns: Sequence[str] | None) -> list[str]:
    cols = list(columns) if columns else list(source.columns)
    missing = [c for c in cols if c not in target.columns]
    if missing:
        raise ValueError(f"target lacks column(s) {missing}")
    return cols


def _common_types(source: DataFrame, target: DataFrame, cols: Sequence[str]) -> dict[str, DataType]:
    """For columns whose two types differ: the type both are compared in.

    Stores name types differently, so INT 1 and DOUBLE 1.0 are the same value.
    Numbers meet as numbers, anything else as text.
    """
    a, b = field_types(source), field_types(target)
    out: dict[str, DataType] = {}
    for c in cols:
        x, y = a[c], b[c]
        if x == y:
            continue
        if not (is_numeric(x) and is_numeric(y)):
            out[c] = StringType()
        elif is_fractional(x) or is_fractional(y):
            out[c] = DoubleType()
        elif isinstance(x, IntegralType) and isinstance(y, IntegralType):
            out[c] = LongType()
        else:
            scale = max(getattr(x, "scale", 0), getattr(y, "scale", 0))
            out[c] = DecimalType(38, scale)
    return out


def verification(source: DataFrame, target: DataFrame, *, checks: Sequence[str] = CHECKS,
                 columns: Sequence[str] | None = None, null_safe: bool = True,
                 algorithm: str = "crc32") -> DataFrame:
    """One row per check: (check_name, source, target, ok) (V2, V3, V5).

    ``row_count`` compares counts; ``checksum`` compares the sum of per-row
    hashes (``null_safe=False`` and crc32 reproduce the reference's
    ``SUM(CRC32(CONCAT_WS(',', ...)))``).  Lazy: one job computes every check.
    """
    bad = set(checks) - set(CHECKS)
    if bad:
        raise ValueError(f"unknown check(s) {sorted(bad)}; use {CHECKS}")
    cols = _aligned(source, target, columns)
    need_hash = "checksum" in checks
    common = _common_types(source, target, cols) if need_hash else {}

    def tagged(df: DataFrame, side: int) -> DataFrame:
        if need_hash:
            df = df.select(*[qcol(c).cast(common[c]).alias(c) if c in common else qcol(c) for c in cols])
        h = (row_hash(cols, null_safe, algorithm).cast(SUM_TYPE) if need_hash
             else F.lit(None).cast(SUM_TYPE))
        return df.select(F.lit(side).alias("side"), h.alias("h"))

    both = tagged(source, 1).unionAll(tagged(target, 2))
    agg = both.agg(
        F.count_if(F.col("side") == 1).cast(SUM_TYPE).alias("n1"),
        F.count_if(F.col("side") == 2).cast(SUM_TYPE).alias("n2"),
        F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("h"))), F.lit(0).cast(SUM_TYPE)).alias("h1"),
        F.coalesce(F.sum(F.when(F.col("side") == 2, F.col("h"))), F.lit(0).cast(SUM_TYPE)).alias("h2"))
    rows = []
    for check in checks:
        a, b = ("n1", "n2") if check == "row_count" else ("h1", "h2")
        rows.append(F.struct(F.lit(check).alias("check_name"), F.col(a).alias("source"),
                             F.col(b).alias("target"), (F.col(a) == F.col(b)).alias("ok")))
    return agg.select(F.inline(F.array(*rows)))


def verify_append(before_rows: int, source: DataFrame, target: DataFrame) -> DataFrame:
    """After an append, target rows must equal rows before plus source rows (V6)."""
    both = (source.select(F.lit(1).alias("side"))
            .unionAll(target.select(F.lit(2).alias("side"))))
    agg = both.agg(F.count_if(F.col("side") == 1).alias("n1"),
                   F.count_if(F.col("side") == 2).alias("n2"))
    expected = F.lit(before_rows) + F.col("n1")
    return agg.select(F.lit("append_count").alias("check_name"),
                      expected.cast(SUM_TYPE).alias("source"),
                      F.col("n2").cast(SUM_TYPE).alias("target"),
                      (expected == F.col("n2")).alias("ok"))


def status(ver: DataFrame) -> str:
    """``success`` when every check holds, else ``failed`` (V5).

    A failed verification does not raise: the copy stays, the status says so.
    """
    bad = ver.where(~F.col("ok")).limit(1).count()
    return "failed" if bad else "success"


def failure_messages(ver: DataFrame) -> DataFrame:
    """Failed checks as text, e.g. ``row_count differs: 10 in the source, 9 in the target``."""
    return ver.where(~F.col("ok")).select("check_name", F.format_string(
        "%s differs: %s in the source, %s in the target", F.col("check_name"),
        F.col("source").cast("string"), F.col("target").cast("string")).alias("details"))


def differing_buckets(source: DataFrame, target: DataFrame, cols: Sequence[str], buckets: int = BUCKETS) -> list[int]:
    """Buckets of rows (by a hash of all columns) in which two tables differ, from one scan of each.

    A bucket's digest is the net count and two net sums of independent row hashes, so equal multisets of rows agree
    whatever their order, and others differ but for a chance of 2^-96.  Only digests are shuffled: at most one row a
    task and bucket.
    """
    def tagged(df: DataFrame, sign: int) -> DataFrame:
        h = F.xxhash64(*[qcol(c) for c in cols])
        return df.select(F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), F.lit(sign).alias("n"), (h.cast(SUM_TYPE) * sign).alias("h"),
                         (F.hash(*[qcol(c) for c in cols]).cast("bigint") * sign).alias("g"))

    net = tagged(source, 1).unionAll(tagged(target, -1)).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("g").alias("g"))
    return sorted(r["bucket"] for r in net.where("n <> 0 OR h <> 0 OR g <> 0").select("bucket").collect())


def row_diff(source: DataFrame, target: DataFrame,
             columns: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows in one table and not the other, as multisets (V9).

    Output: ``side`` (``source_only`` / ``target_only``) then the columns; a
    row present twice in the source and once in the target appears once.
    Same result as ``EXCEPT ALL`` both ways.

    Digests of ``buckets`` hash buckets are compared first (``differing_buckets``); only rows of
    buckets that differ are shuffled by their columns, so two copies of a table with a few
    differences cost their scans.  ``buckets=0`` leaves that step out.
    """
    cols = _aligned(source, target, columns)
    common = _common_types(source, target, cols)
    if buckets and not common and not any(_unhashable(f.dataType) for f in source.schema.fields if f.name in cols):
        found = differing_buckets(source, target, cols, buckets)
        here = F.pmod(F.xxhash64(*[qcol(c) for c in cols]), F.lit(buckets)).cast("int").isin(found) if found else F.lit(False)
        source, target = source.where(here), target.where(here)
    keyed = [qcol(c) for c in cols]
    both = (source.select(*keyed, F.lit(1).alias("__d"))
            .unionAll(target.select(*keyed, F.lit(-1).alias("__d"))))
    net = both.groupBy(*keyed).agg(F.sum("__d").alias("__n")).where(F.col("__n") != 0)
    side = F.when(F.col("__n") > 0, F.lit("source_only")).otherwise(F.lit("target_only"))
    return (net.select(side.alias("side"), *[qcol(c) for c in cols],
                       F.explode(F.sequence(F.lit(1), F.abs(F.col("__n")))).alias("__k"))
            .drop("__k"))


def _unhashable(kind: DataType) -> bool:
    """Whether values that count as equal may hash apart: floats (-0.0, NaN) inside other values, and maps."""
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return isinstance(kind, MapType) or any(_unhashable(t) or is_fractional(t) for t in (
            [kind.elementType] if isinstance(kind, ArrayType) else [f.dataType for f in kind.fields]))
    return False


def copy_table(spark: SparkSession, source: dict, target: dict, *,
               verify_target: dict | None = None, connections: dict | None = None,
               checks: Sequence[str] = CHECKS) -> tuple[int, DataFrame | None]:
    """Full copy of a table, then verification (V1).

    Returns (rows written, verification DataFrame or None).  Overwrite runs
    every check; append has no total to compare unless the caller counted the
    target before (see ``verify_append``).  ``verify_target`` is the spec to
    read the target back (defaults to the target spec itself); text files are
    read back with the source's schema, as they carry no types of their own.

    CSV has one way to write NULL and the empty string, so they count as equal
    there.  The source is read once: its count and checksum are observed while it is
    written, and the check scans the target only.
    """
    df = read_source(spark, source, connections)
    obs = Observation("copied")
    seen = [F.count(F.lit(1)).alias("n")]
    if "checksum" in checks:
        seen.append(F.coalesce(F.sum(F.col("__h").cast(SUM_TYPE)), F.lit(0).cast(SUM_TYPE)).alias("h"))
    blank = target["type"] == "csv"

    def hashed(rows: DataFrame) -> DataFrame:
        if "checksum" not in checks:
            return rows
        text = {f.name for f in rows.schema.fields if blank and isinstance(f.dataType, StringType)}
        return rows.withColumn("__h", row_hash(rows.columns, blank_null=text))

    write_target(hashed(df).observe(obs, *seen).select(*[qcol(c) for c in df.columns]), target, connections)
    got = obs.get
    rows = got.get("n", 0)
    if target.get("mode") != "overwrite":
        return rows, None
    back_spec = dict(verify_target or {k: v for k, v in target.items() if k != "mode"})
    if back_spec.get("type") in ("csv", "json"):
        back_spec["options"] = {"schema": df.schema, **(back_spec.get("options") or {})}
    back = read_source(spark, back_spec, connections)
    missing = [c for c in df.columns if c not in back.columns]
    if missing:
        raise ValueError(f"target lacks column(s) {missing}")
    same = back.select(*[qcol(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    agg = hashed(same).agg(*seen)
    rows_of = {"row_count": ("n", rows), "checksum": ("h", got.get("h"))}
    out = []
    for check in checks:
        name, value = rows_of[check]
        source_value = F.lit(str(value or 0)).cast(SUM_TYPE)
        out.append(F.struct(F.lit(check).alias("check_name"), source_value.alias("source"),
                            F.col(name).cast(SUM_TYPE).alias("target"), (source_value == F.col(name)).alias("ok")))
    return rows, agg.select(F.inline(F.array(*out)))


def compare_listings(source: DataFrame, target: DataFrame, key: str = "Key",
                     digest: str = "ETag", size: str | None = None) -> DataFrame:
    """Per-object check of two listings by key (V4): full outer join.

    ``ok`` is true when the object exists on both sides and digests (and
    sizes, if given) agree; ``reason`` says why not.
    """
    s = source.select(F.col(key).alias("Key"), F.col(digest).alias("source_digest"),
                      *( [F.col(size).alias("source_size")] if size else []))
    t = target.select(F.col(key).alias("Key"), F.col(digest).alias("target_digest"),
                      *( [F.col(size).alias("target_size")] if size else []))
    j = s.join(t, "Key", "full_outer")
    reason = (F.when(F.col("source_digest").isNull() & ~j["Key"].isNull()
                     & F.col("target_digest").isNotNull(), F.lit("missing_in_source"))
               .when(F.col("target_digest").isNull(), F.lit("missing_in_target"))
               .when(~F.col("source_digest").eqNullSafe(F.col("target_digest")),
                     F.lit("digest_mismatch")))
    if size:
        reason = reason.when(~F.col("source_size").eqNullSafe(F.col("target_size")),
                             F.lit("size_mismatch"))
    return j.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
