"""Audit log queries and hygiene.

The log is a table ``(id, user_id, action, resource, details, timestamp)``,
append-only, so every query here also runs on a stream of log rows except the
pages.  Column names can be mapped with ``cols=`` for logs stored under other
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import qcol
from ..functions.text import redact_secrets, truncate_text, warning_flag
from .tables import page

LOG_SCHEMA = ("id bigint, user_id string, action string, resource string, details string, "
              "timestamp timestamp")

# --- fixed values: must equal the reference's behaviour -----------------------
FAILURE_ACTIONS = ("task_failed", "verification_failed")
RECENT_LOGS = 10           # how many newest rows of a resource are searched for a failure
# ------------------------------------------------------------------------------

DEFAULT_COLS = {"id": "id", "user_id": "user_id", "action": "action",
                "resource": "resource", "details": "details", "timestamp": "timestamp"}


def _c(cols: dict | None, name: str):
    return F.col((cols or DEFAULT_COLS).get(name, name))


def filter_log(log: DataFrame, *, user_id=None, action=None, resource=None,
               cols: dict | None = None) -> DataFrame:
    """Equality filters, each optional, all of them must hold (A1)."""
    for name, value in (("user_id", user_id), ("action", action), ("resource", resource)):
        if value is not None and value != "":
            log = log.where(_c(cols, name) == F.lit(value))
    return log


def count_log(log: DataFrame, **filters) -> int:
    """Total rows matching the filters (A2)."""
    return filter_log(log, **filters).count()


def newest_first(log: DataFrame, offset: int = 0, limit: int = 100,
                 cols: dict | None = None) -> DataFrame:
    """A page of the log, newest first, ties by id descending (A3); deep pages as in ``tables.page``."""
    return page(log, [_c(cols, "timestamp").desc(), _c(cols, "id").desc()], offset, limit)


def _id_frame(log: DataFrame, ids, idc: str) -> DataFrame:
    dt = dict((f.name, f.dataType) for f in log.schema.fields)[idc]
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast(dt).alias(idc))
    keys = log.sparkSession.createDataFrame([(int(i),) for i in ids], "k bigint")
    return keys.select(F.col("k").cast(dt).alias(idc))


def delete_entries(log: DataFrame, ids, cols: dict | None = None) -> DataFrame:
    """The log without the given ids (A4): a list or a one-column DataFrame.

    An empty list changes nothing.
    """
    if not isinstance(ids, DataFrame) and not ids:
        return log
    idc = (cols or DEFAULT_COLS)["id"]
    kept = log.join(_id_frame(log, ids, idc), idc, "left_anti")
    return kept.select(*[qcol(c) for c in log.columns])     # a join puts its key first


def count_deleted(log: DataFrame, ids, cols: dict | None = None) -> int:
    """How many of the ids exist (the count a delete returns)."""
    if not isinstance(ids, DataFrame) and not ids:
        return 0
    idc = (cols or DEFAULT_COLS)["id"]
    return log.join(_id_frame(log, ids, idc), idc, "left_semi").count()


def search_by_name(df: DataFrame, name_col: str, query: str | None = None,
                   type_col: str | None = None, type_value: str | None = None) -> DataFrame:
    """Substring match on a name plus an optional type equality (A5)."""
    if query:
        df = df.where(F.col(name_col).contains(query))
    if type_col and type_value:
        df = df.where(F.col(type_col) == type_value)
    return df


def flag_warnings(log: DataFrame, cols: dict | None = None, out: str = "warning") -> DataFrame:
    """Add a boolean column: action or details mention fail/error/delete/...."""
    return log.withColumn(out, warning_flag(_c(cols, "action"), _c(cols, "details")))


def last_failure(log: DataFrame, cols: dict | None = None,
                 recent: int = RECENT_LOGS,
                 failures: Sequence[str] = FAILURE_ACTIONS) -> DataFrame:
    """Per resource: details of the newest failure among its ``recent`` newest rows.

    ``row_number() <= recent`` is planned with a partial per-resource limit
    before the shuffle, so a resource with a huge history sends at most
    ``recent`` rows per task; the pick among them is an aggregate.
    Output: resource, failed_at, failure_action, failure_id, details.
    """
    res, ts, idc = _c(cols, "resource"), _c(cols, "timestamp"), _c(cols, "id")
    w = Window.partitionBy(res).orderBy(ts.desc(), idc.desc())
    recent_rows = (log.select(res.alias("resource"), ts.alias("ts"), idc.alias("id"),
                              _c(cols, "action").alias("action"),
                              _c(cols, "details").alias("details"),
                              F.row_number().over(w).alias("rn"))
                   .where(F.col("rn") <= recent))
    hits = recent_rows.where(F.col("action").isin(*failures))
    first = F.min_by(F.struct("ts", "action", "id", "details"), F.col("rn"))
    return (hits.groupBy("resource").agg(first.alias("f"))
            .select("resource", F.col("f.ts").alias("failed_at"),
                    F.col("f.action").alias("failure_action"), F.col("f.id").alias("failure_id"),
                    F.col("f.details").alias("details")))


def sanitize_details(log: DataFrame, cols: dict | None = None) -> DataFrame:
    """Redact secrets, then cap the length of the details column."""
    d = (cols or DEFAULT_COLS)["details"]
    return log.withColumn(d, truncate_text(redact_secrets(F.col(d))))


def audit_entry(spark, user_id: str, action: str, resource: str, details: str | None = None,
                entry_id: int | None = None) -> DataFrame:
    """One log row, redacted and capped, ready to append."""
    df = spark.createDataFrame([(entry_id, user_id, action, resource, details)],
                               "id bigint, user_id string, action string, resource string, "
                               "details string")
    return sanitize_details(df.withColumn("timestamp", F.current_timestamp()))


def append_log(entries: DataFrame, path: str) -> None:
    """Append rows to the log table (A11); a stream uses ``writeStream`` the same way."""
    entries.write.mode("append").parquet(path)


def deleted_summary(deleted: DataFrame, name_col: str = "name") -> DataFrame:
    """``Deleted N tasks: a, b, c`` for one delete request.

    The names are those of a single user request, so the list is bounded by
    what one request deletes.
    """
    names = F.array_join(F.array_sort(F.collect_list(F.col(name_col))), ", ")
    n = F.count(F.lit(1))
    return deleted.agg(n.alias("n"), names.alias("names")).select(
        "n", F.format_string("Deleted %d tasks: %s", F.col("n"), F.col("names")).alias("details"))
