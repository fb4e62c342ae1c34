"""Column expressions: naming, type detection, text hygiene, coercion, hashing."""

from .coerce import coerce_text, rejected
from .columns import (numeric_columns, qcol, quote, resolve_columns)
from .hashing import checksum, row_hash, row_text
from .text import redact_secrets, truncate_text, warning_flag

__all__ = [
    "checksum", "coerce_text", "numeric_columns", "qcol", "quote", "redact_secrets",
    "rejected", "resolve_columns", "row_hash", "row_text", "truncate_text", "warning_flag",
]
