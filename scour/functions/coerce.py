"""Typed coercion of user text.

Edited values arrive as text.  The empty string means NULL; integers must be
whole numbers, fractional types accept any decimal or exponent literal, booleans
accept a short word list.  Text that does not parse becomes NULL and the row is
flagged, because a typed column cannot keep the original text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DecimalType, DoubleType,
                               FloatType, IntegralType, StringType)

# --- fixed values: must equal the reference's behaviour -----------------------
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
# ------------------------------------------------------------------------------

INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
# a decimal or exponent literal: Spark's own cast also takes "12d", "3F" and "0x1p3"
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
SPECIAL_TEXT = r"^\s*([+-]?(inf|infinity)|nan)\s*$"

WRAPPED = re.compile(r"(?:Nullable|LowCardinality)\((.*)\)", re.S)
CLICKHOUSE_TYPES = {
    "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint",
    "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)",
    "Float32": "float", "Float64": "double", "Bool": "boolean", "String": "string",
    "Date": "date", "Date32": "date", "DateTime": "timestamp",
}


def parse_type(name: str) -> DataType:
    """A Spark type from its own name or from ClickHouse's, ``Nullable(T)`` unwrapped."""
    name = name.strip()
    while m := WRAPPED.fullmatch(name):
        name = m[1].strip()
    if m := re.fullmatch(r"U?Int(?:128|256)", name):
        return DecimalType(38, 0)
    if m := re.fullmatch(r"DateTime(?:64)?\(.*\)", name):
        return DataType.fromDDL("timestamp")
    return DataType.fromDDL(CLICKHOUSE_TYPES.get(name, name))


def coerce_text(text: Column, to: DataType) -> Column:
    """Parse a string column into ``to``; NULL where empty or unparsable."""
    v = F.nullif(text, F.lit(""))
    if isinstance(to, StringType):
        return v
    if isinstance(to, BooleanType):
        low = F.lower(v)
        return (F.when(low.isin(*TRUE_WORDS), F.lit(True))
                 .when(low.isin(*FALSE_WORDS), F.lit(False)))
    if isinstance(to, IntegralType):
        # whole numbers only: "1.5" and "1e3" are rejected, not rounded
        return F.when(v.rlike(INTEGER_TEXT), F.trim(v).try_cast(to))
    if isinstance(to, DecimalType):
        return F.when(v.rlike(NUMBER_TEXT), F.trim(v).try_cast(to))
    if isinstance(to, (FloatType, DoubleType)):
        return F.when(v.rlike(NUMBER_TEXT) | F.lower(v).rlike(SPECIAL_TEXT), F.trim(v).try_cast(to))
    return v.try_cast(to)


def rejected(text: Column, coerced: Column) -> Column:
    """True when non-empty text was given but could not be parsed."""
    return text.isNotNull() & (text != F.lit("")) & coerced.isNull()
