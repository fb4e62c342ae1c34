"""Text hygiene expressions for logs and free text.

All three are plain column expressions, so they run inside whole-stage codegen
and work unchanged on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the reference's behaviour -----------------------
# A database URL's password (scheme mysql+pymysql://user:PASSWORD@), then
# any "password", "passwd" or "pwd" followed by ":" or "=" and a value that runs
# up to a comma, whitespace, quote or backslash.  Case-insensitive; the secret
# becomes four asterisks.
DB_URL_PASSWORD = r"(?i)(mysql\+pymysql://[^:\s]+:)([^@\s]+)(@)"
KEY_VALUE_PASSWORD = r"""(?i)((?:password|passwd|pwd)\s*[:=]\s*)([^,\s'"\\]+)"""
MASK = "****"
# A10: cap on stored failure details and the marker appended after the cut.
DETAIL_LIMIT = 8000
TRUNCATION_SUFFIX = "\n...<truncated>"
# Words that flag an audit row as a warning (lower case, substring match).
WARNING_WORDS = ("fail", "error", "delete", "exception", "warning")
# ------------------------------------------------------------------------------


def redact_secrets(text: Column) -> Column:
    """Mask database URL passwords and ``password=…`` style values.

    Each regex runs only on texts whose lower-cased form contains its trigger
    word ("mysql+pymysql://"; "pass" or "pwd").  The guard is exact: the
    patterns are ASCII case-insensitive, so any match implies the trigger is
    in the lower-cased text; texts without it are returned untouched, and the
    expensive scan is skipped for most rows.
    """
    low = F.lower(text)
    step = F.when(low.contains("mysql+pymysql://"),
                  F.regexp_replace(text, DB_URL_PASSWORD, "$1" + MASK + "$3")).otherwise(text)
    return F.when(low.contains("pass") | low.contains("pwd"),
                  F.regexp_replace(step, KEY_VALUE_PASSWORD, "$1" + MASK)).otherwise(step)


def truncate_text(text: Column, limit: int = DETAIL_LIMIT,
                  suffix: str = TRUNCATION_SUFFIX) -> Column:
    """Cut text longer than ``limit`` characters and mark the cut (A10)."""
    return F.when(F.length(text) > limit,
                  F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def warning_flag(action: Column, details: Column | None = None,
                 words: tuple[str, ...] = WARNING_WORDS) -> Column:
    """True when action + details mention a failure word, case-insensitively."""
    parts = [action] if details is None else [action, details]
    text = F.lower(F.concat_ws(" ", *parts))
    flag = F.lit(False)
    for w in words:
        flag = flag | text.contains(w)
    return flag
