"""Statistics and scaling (M1-M6).

Statistics are computed with one aggregate over all columns (bounded result:
one row), then applied as literals, so the plan that writes the data is a plain
filter / projection whose range predicates can reach the scan.  NaN is treated
like NULL throughout: it is not counted, averaged or ranked.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.columns import contains_map, field_types, is_fractional, non_nan, qcol, resolve_columns
from .quantiles import quantiles, quantiles_and_aggregates

PROFILE_STATS = ("count", "mean", "stddev", "min", "p25", "p50", "p75", "max")
SUMMARY_NAMES = {"p25": "25%", "p50": "50%", "p75": "75%"}      # as Spark's summary() has them


# -- M1 / M2: profile -----------------------------------------------------------------

def profile(df: DataFrame, columns: Sequence[str] | None = None, *,
            error: float | None = None) -> DataFrame:
    """One row per numeric column (``column_name``): count, mean, stddev (sample),
    min, quartiles (p25, p50, p75), max.

    Quartiles are exact and linearly interpolated unless ``error`` is given.
    The moments are computed in the first pass of the quantile search, so an
    exact profile of any number of columns costs two scans of them (moments
    and sketches, then one histogram; a further one where a bracket holds many
    rows); the result (one row per column) is built from that bounded summary.
    """
    cols = resolve_columns(df, columns, numeric=True)
    schema = ("column_name string, count bigint, mean double, stddev double, min double, "
              "p25 double, p50 double, p75 double, max double")
    rows, _ = _profile_rows(df, cols, error, [])
    return df.sparkSession.createDataFrame(rows, schema)


def _profile_rows(df: DataFrame, cols: list[str], error: float | None, extra: list):
    """Profile tuples of numeric columns, plus a row of ``extra`` aggregates.

    Exact mode: mean and stddev join the quantile search's first pass, whose
    counts and finite range also give count, min and max (NULL and NaN are not
    values; +-infinity are), so the wide first aggregate stays small.
    """
    if not cols:
        return [], (df.agg(*extra).first() if extra else None)
    moments = list(extra)
    for i, c in enumerate(cols):
        x = non_nan(c, df).cast("double")
        moments += [F.avg(x).alias(f"__a{i}"), F.stddev_samp(x).alias(f"__s{i}")]
    if error is None:
        q, row = quantiles_and_aggregates(df, cols, [0.25, 0.5, 0.75], moments)
        out = []
        for i, c in enumerate(cols):
            n, ninf, pinf = row[f"n{i}"], row[f"ni{i}"], row[f"pi{i}"]
            lo = float("-inf") if ninf else (row[f"mn{i}"] if n else (float("inf") if pinf else None))
            hi = float("inf") if pinf else (row[f"mx{i}"] if n else (float("-inf") if ninf else None))
            out.append((c, n + ninf + pinf, row[f"__a{i}"], row[f"__s{i}"],
                        None if lo is None else float(lo), *q[c],
                        None if hi is None else float(hi)))
        return out, row
    for i, c in enumerate(cols):
        x = non_nan(c, df).cast("double")
        moments += [F.count(x).alias(f"__n{i}"), F.min(x).alias(f"__lo{i}"),
                    F.max(x).alias(f"__hi{i}")]
    q, row = quantiles(df, cols, [0.25, 0.5, 0.75], error=error), df.agg(*moments).first()
    out = [(c, row[f"__n{i}"], row[f"__a{i}"], row[f"__s{i}"], row[f"__lo{i}"],
            *q[c], row[f"__hi{i}"]) for i, c in enumerate(cols)]
    return out, row


def explore(df: DataFrame, *, error: float | None = None) -> dict:
    """Report as a dict: total_rows, columns and a summary per statistic (M1).

    The summary has one entry per statistic, under the names of Spark's
    ``summary()`` (count, mean, stddev, min, 25%, 50%, 75%, max), with one key
    per column.  Numeric columns have every statistic; of other columns mean,
    stddev and quartiles are None, and of maps, which have no order, min and max too.
    """
    types = field_types(df)
    numeric = resolve_columns(df, None, numeric=True)
    others = [c for c in df.columns if c not in numeric]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(others):
        x = F.lit(None).cast("string") if contains_map(types[c]) else qcol(c)
        aggs += [F.count(qcol(c)).alias(f"__on{i}"), F.min(x).cast("string").alias(f"__olo{i}"),
                 F.max(x).cast("string").alias(f"__ohi{i}")]
    if numeric:
        # numeric moments, quartiles and the other columns' stats share the scans
        prof, head = _profile_rows(df, numeric, error, aggs)
        stats = {r[0]: dict(zip(("column_name", *PROFILE_STATS), r)) for r in prof}
    else:
        head, stats = df.agg(*aggs).first(), {}
    summary = []
    at = {c: i for i, c in enumerate(others)}
    for stat in PROFILE_STATS:
        entry = {"summary": SUMMARY_NAMES.get(stat, stat)}
        for c in df.columns:
            if c in stats:
                entry[c] = stats[c][stat]
            else:
                name = {"count": "__on", "min": "__olo", "max": "__ohi"}.get(stat)
                entry[c] = head[f"{name}{at[c]}"] if name else None
        summary.append(entry)
    return {"total_rows": head["__rows"], "columns": list(df.columns), "summary": summary}


def explore_json(df: DataFrame, *, error: float | None = None) -> str:
    """The report of ``explore`` as JSON; what JSON has no type for is text."""
    return json.dumps(explore(df, error=error), ensure_ascii=False, default=str)


# -- M3 / M4: IQR outlier filter ------------------------------------------------------

def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5, *,
               error: float | None = None) -> dict[str, tuple[float, float] | None]:
    """``{column: (q1 - f*iqr, q3 + f*iqr)}``; None for a column with no value."""
    q = quantiles(df, list(columns), [0.25, 0.75], error=error)
    out = {}
    for c in columns:
        q1, q3 = q[c]
        if q1 is None or q3 is None:
            out[c] = None
        else:
            iqr = q3 - q1
            out[c] = (q1 - factor * iqr, q3 + factor * iqr)
    return out


def within_bounds(df: DataFrame, bounds: dict, keep_nulls: bool = True) -> DataFrame:
    """Apply bounds as one literal range filter (NULL/NaN rows kept if asked)."""
    types = field_types(df)
    cond = None
    for c, b in bounds.items():
        if b is None:
            continue
        x = qcol(c)
        lo, hi = _typed_bounds(b, types[c])
        inside = (x >= lo) & (x <= hi)
        if is_fractional(types[c]):
            inside = inside & ~F.isnan(x)
            gap = x.isNull() | F.isnan(x)
        else:
            gap = x.isNull()
        term = (inside | gap) if keep_nulls else inside
        cond = term if cond is None else cond & term
    return df if cond is None else df.where(cond)


def _typed_bounds(b: tuple[float, float], dt) -> tuple[Column, Column]:
    """Bounds as literals of the column's own type, so the comparison needs no
    cast and reaches the Parquet scan.  Integers: ``x >= 2.5`` is ``x >= 3``."""
    if isinstance(dt, IntegralType):
        lo, hi = math.ceil(b[0]), math.floor(b[1])
        if lo > hi:                                     # no integer inside: keep none
            return F.lit(1).cast(dt), F.lit(0).cast(dt)
        low_end, high_end = _INT_RANGE[dt.typeName()]
        return (F.lit(max(lo, low_end)).cast(dt), F.lit(min(hi, high_end)).cast(dt))
    return F.lit(b[0]), F.lit(b[1])


_INT_RANGE = {"byte": (-2 ** 7, 2 ** 7 - 1), "short": (-2 ** 15, 2 ** 15 - 1),
              "integer": (-2 ** 31, 2 ** 31 - 1), "long": (-2 ** 63, 2 ** 63 - 1)}


def handle_outliers(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr",
                    *, factor: float = 1.5, sequential: bool = True, keep_nulls: bool = True,
                    error: float | None = None) -> DataFrame:
    """Keep rows inside ``[q1 - 1.5 iqr, q3 + 1.5 iqr]`` for each column (M3).

    ``sequential=True`` takes the bounds of each column from the rows left by
    the previous columns (the reference behaviour; one statistics job per
    column).  ``sequential=False`` takes all bounds from the input in one go.
    Quartiles are exact unless ``error`` is set (``error=0.05`` is the
    reference's Spark setting).  A column with no value removes nothing.
    """
    if method != "iqr":
        raise ValueError(f"unknown outlier method {method!r}; only 'iqr' is supported")
    cols = resolve_columns(df, columns, numeric=True)
    if not cols:
        return df
    if not sequential:
        return within_bounds(df, iqr_bounds(df, cols, factor, error=error), keep_nulls)
    for c in cols:
        df = within_bounds(df, iqr_bounds(df, [c], factor, error=error), keep_nulls)
    return df


# -- M5: z-score ------------------------------------------------------------------------

def fit_standardize(df: DataFrame, columns: Sequence[str] | None = None
                    ) -> dict[str, tuple[float | None, float | None]]:
    """``{column: (mean, stddev_samp)}`` from one aggregate (the fit half of M5)."""
    cols = resolve_columns(df, columns, numeric=True)
    if not cols:
        return {}
    row = df.agg(*[e for i, c in enumerate(cols) for e in
                   (F.avg(non_nan(c, df)).alias(f"m{i}"),
                    F.stddev_samp(non_nan(c, df)).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def apply_standardize(df: DataFrame, scale: dict[str, tuple[float | None, float | None]]
                      ) -> DataFrame:
    """Apply fitted (mean, stddev) as literals; works on streaming DataFrames too.

    Columns whose standard deviation is NULL or zero are left unchanged.
    """
    out = []
    for c in df.columns:
        m, s = scale.get(c, (None, None))
        if s is None or s == 0 or m is None:
            out.append(qcol(c))
        else:
            out.append(((qcol(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c))
    return df.select(*out)


def standardize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(x - mean) / stddev_samp`` per numeric column, stats in one aggregate (M5).

    Columns whose standard deviation is NULL (fewer than two values) or zero
    are left unchanged; standardized columns become DOUBLE.  For a stream, fit
    on a batch with ``fit_standardize`` and ``apply_standardize`` the stream.
    """
    return apply_standardize(df, fit_standardize(df, columns))


# -- M6: row counts without an extra job --------------------------------------------------

def observe_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Attach a row counter that fills in when the DataFrame is next executed."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
