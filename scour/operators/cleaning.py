"""Row and column cleaning.

Every function is ``DataFrame -> DataFrame`` and lazy, so chains of them become
one Catalyst plan: projections collapse, filters reach the scan.  Fills with a
statistic (P6) compute the statistic first (one aggregate, bounded result) and
then apply literals, which keeps the final plan a plain projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DateType, IntegralType, NumericType,
                               StringType, TimestampNTZType)

from ..functions.columns import (field_types, has_map_column, is_fractional,
                                 is_numeric, lossless_fill, missing, non_nan, qcol,
                                 resolve_columns, value_matches)
from .quantiles import quantiles

OrderSpec = Sequence[str | Column | tuple[str, str]]


# -- P1 / P2: deduplication -----------------------------------------------------

def dedup(df: DataFrame, columns: Sequence[str] | None = None,
          order_by: OrderSpec | None = None) -> DataFrame:
    """Drop duplicate rows (P1) or keep one row per key.

    Whole-row and key-only dedup plan as a partial aggregate before the
    shuffle, so a key holding a third of the table still leaves each map task
    with one row for it.  NULL equals NULL, NaN equals NaN, 0.0 equals -0.0.

    With ``columns`` and no ``order_by`` only the key columns are promised;
    which row survives is Spark's choice.  With ``order_by`` the first row in
    that order is kept deterministically (ties broken by every other column):
    ``row_number() = 1``, which Spark plans with a partial per-key limit on the
    map side, so hot keys are cut down before the exchange.
    """
    bad = has_map_column(df, columns)
    if bad:
        raise ValueError(f"cannot deduplicate on MAP column(s) {bad}: maps are not comparable")
    if not columns:
        return df.dropDuplicates()
    cols = resolve_columns(df, columns)
    if not order_by:
        return df.dropDuplicates(cols)
    order = _order_columns(order_by)
    rest = [qcol(c).asc_nulls_last() for c in df.columns
            if c not in cols and not has_map_column(df, [c])]
    from pyspark.sql import Window
    w = Window.partitionBy(*[qcol(c) for c in cols]).orderBy(*order, *rest)
    tag = "__scour_rn"
    return df.withColumn(tag, F.row_number().over(w)).where(F.col(tag) == 1).drop(tag)


def _order_columns(order_by: OrderSpec) -> list[Column]:
    out = []
    for o in order_by:
        if isinstance(o, Column):
            out.append(o)
        elif isinstance(o, tuple):
            name, direction = o
            c = qcol(name)
            out.append(c.desc_nulls_last() if direction.lower().startswith("desc")
                       else c.asc_nulls_last())
        else:
            out.append(qcol(o).asc_nulls_last())
    return out


# -- P3: predicate filter -------------------------------------------------------

def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    """Keep rows where a Spark SQL predicate holds (P3); pushed to the scan."""
    if isinstance(condition, str):
        if not condition.strip():
            raise ValueError("filter condition is empty")
        condition = F.expr(condition)
    return df.where(condition)


# -- P4 / P5 / P6: filling missing values -----------------------------------------

FILL_METHODS = ("constant", "mean", "median", "mode")


def fill_na(df: DataFrame, value=None, columns: Sequence[str] | None = None,
            method: str | None = None) -> DataFrame:
    """Replace NULL (and NaN in float columns).

    ``method="constant"`` (default when ``value`` is given) fills columns whose
    type matches the value: strings for a string, numbers for a number,
    booleans for a bool.  A string fill such as ``"0123"`` stays a string.
    Without ``columns`` columns of another type are left alone.  A listed column
    of another type, a fill that a column's type would round (a fraction into an
    integer column), or a missing value raise.

    ``mean`` / ``median`` / ``mode`` fill numeric columns (mode: any orderable
    column) with the statistic of the non-missing values; integer columns get
    the statistic rounded half-up.  Median is exact (see ``quantiles``); mode
    is the most frequent value, the smallest on ties.
    """
    method = method or ("constant" if value is not None else None)
    if method not in FILL_METHODS:
        raise ValueError(f"fill_na needs a value or a method in {FILL_METHODS}, got {method!r}")
    types = field_types(df)
    if method == "constant":
        if value is None:
            raise ValueError("fill_na(method='constant') needs a non-null value")
        fills = _constant_targets(types, value, columns)
    elif method in ("mean", "median"):
        cols = resolve_columns(df, columns, numeric=True)
        fills = _statistic(df, cols, method)
    else:
        cols = resolve_columns(df, columns)
        fills = mode_values(df, cols)
    return apply_fills(df, fills)


def _constant_targets(types: dict[str, DataType], value, columns) -> dict:
    cols = list(columns) if columns else [c for c, dt in types.items() if value_matches(value, dt)]
    unknown = [c for c in cols if c not in types]
    if unknown:
        raise ValueError(f"unknown column(s): {unknown}")
    wrong = [c for c in cols if not value_matches(value, types[c])]
    if wrong:
        raise ValueError(f"fill value {value!r} does not match the type of {wrong}")
    lossy = [c for c in cols if not lossless_fill(value, types[c])]
    if lossy:
        raise ValueError(f"fill value {value!r} would be truncated in {lossy}; list the columns to fill")
    return {c: value for c in cols}


def _statistic(df: DataFrame, cols: list[str], method: str) -> dict:
    if not cols:
        return {}
    if method == "mean":
        row = df.agg(*[F.avg(non_nan(c, df)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        return {c: row[f"m{i}"] for i, c in enumerate(cols)}
    q = quantiles(df, cols, [0.5])
    return {c: q[c][0] for c in cols}


def mode_values(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-missing value per column, smallest on ties.

    One scan and one shuffle for all columns: values are counted as (column,
    value) pairs with partial aggregation, so no task keeps a map of a column's
    values, and one aggregate per column picks the winner among the counts.
    """
    types = field_types(df)
    plain = [c for c in cols if _textual(types[c])]
    out = {c: None for c in cols}
    if plain:
        pairs = [F.when(~missing(qcol(c), types[c]), F.struct(F.lit(i).alias("i"), qcol(c).cast("string").alias("v")))
                 for i, c in enumerate(plain)]
        counted = (df.select(F.explode(F.array(*pairs)).alias("p")).where(F.col("p").isNotNull())
                   .groupBy("p.i", "p.v").agg(F.count(F.lit(1)).alias("n")))
        best = [F.min(F.when(F.col("i") == i, F.struct((-F.col("n")).alias("n"), F.col("v").cast(types[c]).alias("v")))).alias(f"m{i}")
                for i, c in enumerate(plain)]
        row = counted.agg(*best).first()
        out.update({c: row[f"m{i}"] and row[f"m{i}"]["v"] for i, c in enumerate(plain)})
    for c in cols:
        if c not in plain:
            counted = df.where(~missing(qcol(c), types[c])).groupBy(qcol(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            top = counted.orderBy(F.col("n").desc(), F.col("v").asc()).first()
            out[c] = None if top is None else top["v"]
    return out


def _textual(dt: DataType) -> bool:
    """Whether a value survives the way through its text."""
    return isinstance(dt, (NumericType, StringType, BooleanType, DateType, TimestampNTZType))


def apply_fills(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """One projection: ``coalesce`` (and ``nanvl`` for floats) per filled column."""
    types = field_types(df)
    fills = {c: v for c, v in fills.items() if v is not None}
    if not fills:
        return df
    out = []
    for c in df.columns:
        if c not in fills:
            out.append(qcol(c))
            continue
        dt, v = types[c], fills[c]
        lit = F.lit(v)
        if isinstance(dt, IntegralType) and isinstance(v, float):
            lit = F.round(lit, 0)
        lit = lit.cast(dt)
        x = qcol(c)
        if is_fractional(dt):
            x = F.nanvl(x, F.lit(None).cast(dt))
        out.append(F.coalesce(x, lit).alias(c))
    return df.select(*out)


# -- P7 / P8: dropping rows with missing values -------------------------------------

def drop_na(df: DataFrame, columns: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows with a NULL (or NaN) in any / all of the columns."""
    if how not in ("any", "all"):
        raise ValueError("how must be 'any' or 'all'")
    cols = resolve_columns(df, columns)
    return df.na.drop(how=how, subset=cols)


# -- P9: renaming -------------------------------------------------------------------

def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename all at once (P9): ``{a: b, b: a}`` swaps; unknown names are ignored.

    The result must have unique names, otherwise it raises.
    """
    names = [mapping.get(c, c) for c in df.columns]
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise ValueError(f"rename would produce duplicate column name(s) {dupes}")
    if names == df.columns:
        return df
    return df.select(*[qcol(c).alias(n) for c, n in zip(df.columns, names)])


# -- P10 is functions.columns.numeric_columns ----------------------------------------

__all__ = ["apply_fills", "dedup", "drop_na", "fill_na", "filter_rows", "is_numeric",
           "mode_values", "rename_columns"]
