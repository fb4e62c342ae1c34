"""Column naming and type helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DecimalType, DoubleType,
                               FloatType, IntegralType, MapType, NumericType,
                               StringType)


def quote(name: str) -> str:
    """Backtick-quote a column name so dots, spaces and non-ASCII letters work."""
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    return F.col(quote(name))


def field_types(df: DataFrame) -> dict[str, DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def is_numeric(dt: DataType) -> bool:
    return isinstance(dt, NumericType)


def is_fractional(dt: DataType) -> bool:
    return isinstance(dt, (FloatType, DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    """Every numeric column: byte, short, int, long, float, double and decimal (P10)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def resolve_columns(df: DataFrame, columns: Iterable[str] | None, *,
                    numeric: bool = False) -> list[str]:
    """Validate a user column list, or default to all (numeric) columns.

    Unknown names raise; with ``numeric=True`` a non-numeric column raises too,
    instead of being skipped silently.
    """
    types = field_types(df)
    if not columns:
        return numeric_columns(df) if numeric else list(df.columns)
    cols = list(columns)
    missing = [c for c in cols if c not in types]
    if missing:
        raise ValueError(f"unknown column(s): {missing}; table has {list(types)}")
    if numeric:
        bad = [c for c in cols if not is_numeric(types[c])]
        if bad:
            raise ValueError(f"column(s) {bad} are not numeric")
    return cols


def value_matches(value, dt: DataType) -> bool:
    """Whether a fill constant belongs to a column type (Spark's na.fill rule)."""
    if isinstance(value, bool):
        return isinstance(dt, BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(dt, NumericType)
    if isinstance(value, str):
        return isinstance(dt, StringType)
    return False


def lossless_fill(value, dt: DataType) -> bool:
    """A numeric constant fits the column type without truncation."""
    if isinstance(dt, IntegralType) and isinstance(value, float):
        return value.is_integer()
    if isinstance(dt, DecimalType) and isinstance(value, (int, float)) and not isinstance(value, bool):
        exact = Decimal(str(value))
        if not exact.is_finite():
            return False
        _, digits, exponent = exact.normalize().as_tuple()
        return exponent >= -dt.scale and len(digits) + exponent <= dt.precision - dt.scale
    return True


def has_map_column(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    types = field_types(df)
    names = list(columns) if columns else list(types)
    return [c for c in names if contains_map(types[c])]


def contains_map(dt: DataType) -> bool:
    if isinstance(dt, MapType):
        return True
    inner = getattr(dt, "elementType", None)
    if inner is not None:
        return contains_map(inner)
    fields = getattr(dt, "fields", None)
    if fields:
        return any(contains_map(f.dataType) for f in fields)
    return False


def missing(c: Column, dt: DataType) -> Column:
    """NULL, or NaN for float/double columns: both count as missing."""
    if is_fractional(dt):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def non_nan(c: str, df: DataFrame) -> Column:
    """The column with NaN as NULL."""
    x = qcol(c)
    return F.when(~F.isnan(x), x) if is_fractional(field_types(df)[c]) else x
