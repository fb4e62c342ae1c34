"""Incremental ingest (R1, R2) with Structured Streaming.

R1 (poll a source every N seconds for a while and append to a target) is a
file stream with a processing-time trigger; ``available_now`` processes what
is there and stops, which is what tests and catch-up runs want.  Progress
lives in the checkpoint folder, so a restarted query resumes where it stopped
and a lost executor only re-runs its micro-batch.

R2 (fetch only rows added since the last poll, in bounded batches) needs a
monotone key: the reference's "row count at open" breaks as soon as a row is
deleted.  For files the file source already reads only new files
(``max_files_per_trigger`` bounds a batch).  A Parquet table is polled as a stream
(``poll_stream``), with marks as Spark's own offsets.  For any other table
``poll_table`` appends increments: each first records the key range it is about to
take, then writes exactly that range to a folder of its own below the target, so a
poll that died is done again with the same range and the same folder.  The target
is never scanned for its state.

Row-wise operators (filter, fill with a constant, drop_na, rename, coercion,
redaction, truncation, warning flags) apply to streaming DataFrames unchanged.
Statistics are fitted on a batch and applied to the stream as literals
(``stats.fit_standardize`` / ``apply_standardize``, ``stats.iqr_bounds`` /
``within_bounds``); deduplication uses a watermark (``dedup_stream``).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.columns import field_types, qcol
from ..session import delete_path, path_exists
from ..sources.polled import polled
from .dedup import dedup_first, micros, state_settings, waiting_rows

# --- fixed values: must equal the reference's behaviour -----------------------
POLL_SECONDS = 5           # default poll interval
# ------------------------------------------------------------------------------

MAX_RANGES, SAMPLE = 10_000, 20_000     # ranges of one increment; rows that place a cut beyond them


def file_stream(spark: SparkSession, path: str, fmt: str, schema, *,
                pattern: str | None = None, max_files_per_trigger: int | None = None,
                **options) -> DataFrame:
    """A streaming DataFrame over files arriving below ``path``."""
    r = spark.readStream.format(fmt).schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        r = r.option("header", True)
    return r.options(**options).load(path)


def _trigger(writer, available_now: bool, interval_seconds: float):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{interval_seconds} seconds")


def ingest(stream: DataFrame, target: str, checkpoint: str, *, fmt: str = "parquet",
           transform: Callable[[DataFrame], DataFrame] | None = None,
           available_now: bool = False, interval_seconds: float = POLL_SECONDS,
           duration_seconds: float | None = None, partition_by=None) -> StreamingQuery:
    """Append a (transformed) stream to a file target.

    With ``available_now`` the call returns once everything present is
    written; otherwise it polls every ``interval_seconds`` and stops after
    ``duration_seconds`` (or runs until stopped when None).
    """
    df = transform(stream) if transform else stream
    w = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = _trigger(w, available_now, interval_seconds).start(target)
    if available_now:
        q.awaitTermination()
    elif duration_seconds is not None:
        q.awaitTermination(duration_seconds)
        q.stop()
    return q


def dedup_stream(stream: DataFrame, columns: list[str], event_time: str,
                 delay: str = "10 minutes") -> DataFrame:
    """Drop duplicate keys of a stream with bounded state (P1/P2 on streams).

    A key seen again within ``delay`` of event time is dropped; state for a
    key is evicted once the watermark passes it, so memory stays bounded by
    the keys of one delay window rather than growing with the stream.
    """
    from pyspark.sql.types import TimestampNTZType
    dt = dict((f.name, f.dataType) for f in stream.schema.fields)[event_time]
    if isinstance(dt, TimestampNTZType):
        # watermarks need TIMESTAMP; wall-clock time read in the session zone
        tag = "__event_time"
        keyed = stream.withColumn(tag, qcol(event_time).cast("timestamp"))
        return (keyed.withWatermark(tag, delay).dropDuplicatesWithinWatermark(columns)
                .drop(tag))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(columns)


def dedup_ingest(stream: DataFrame, columns: list[str], event_time: str, target: str, checkpoint: str, *,
                 delay: str = "10 minutes", lateness: str = "10 minutes", order: Sequence[str] = (), available_now: bool = False,
                 close: bool = False, interval_seconds: float = POLL_SECONDS) -> StreamingQuery:
    """Append the rows of a stream to ``target``, one per key within ``delay`` of event time: the first.

    See ``dedup.dedup_first``: which rows are kept depends on the rows alone, not on files or batches, and NULL keys
    are equal.  A row is written when the watermark (``lateness`` behind the newest event) has passed it.  ``close``
    (with ``available_now``) says that the stream has ended: the rows that still wait are decided and written too.
    """
    if close and not available_now:
        raise ValueError("close needs available_now: a stream that goes on is not at its end")
    spark = stream.sparkSession
    kept = dedup_first(stream, columns, event_time, within=delay, lateness=lateness, order=order)
    w = kept.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    with state_settings(spark):
        q = _trigger(w, available_now, interval_seconds).start(f"{target}/kept")
    if available_now:
        q.awaitTermination()
    if close and micros(spark, delay) > 0:      # otherwise no row has waited
        waiting_rows(spark, checkpoint, stream.schema, columns, delay).write.mode("overwrite").parquet(f"{target}/closing")
    return q


def next_increment(source: DataFrame, key: str, after: tuple | None = None, max_rows: int | None = None,
                   tie_break: str | None = None) -> tuple[DataFrame, tuple] | None:
    """The next rows of ``source`` behind the mark ``after``, and the mark that ends them (R2).

    A mark is a (key, tie_break) pair; with no ``tie_break`` its second half is
    None and a batch always takes all rows of its last key, so no row that ties
    with a mark is ever left behind (``max_rows`` is then a lower bound where the
    last key has many rows).  With a ``tie_break`` that tells rows of one key
    apart, batches hold exactly ``max_rows`` rows and rows that arrive later
    under the mark's key are still found.  None when nothing is new.

    Rows with a NULL key (or tie-break) have no place in the order: they raise.
    """
    k, t = qcol(key), qcol(tie_break) if tie_break else F.lit(None).cast("int")
    order = [k] if tie_break is None else [k, t]
    gap = k.isNull() if tie_break is None else k.isNull() | t.isNull()
    if after is not None:
        behind = k > F.lit(after[0])
        if tie_break is not None:
            behind = (k >= F.lit(after[0])) & (behind | (t > F.lit(after[1])))
        source = source.where(behind | gap)
    ends = source.select(k.alias("k"), t.alias("t"), gap.alias("gap"))
    if max_rows:
        # NULLs sort first, so one of them is seen if there is any
        ends = ends.orderBy(*([F.col("k"), F.col("t")] if tie_break else [F.col("k")])).limit(max_rows)
    row = ends.agg(F.max(F.struct("k", "t")).alias("top"), F.count_if("gap").alias("gaps")).first()
    if row["gaps"]:
        raise ValueError(f"rows with a NULL in {[c for c in (key, tie_break) if c]} cannot be polled in order")
    if row["top"] is None:
        return None
    mark = (row["top"]["k"], row["top"]["t"])
    upto = k <= F.lit(mark[0])
    if tie_break is not None:
        upto = upto & ((k < F.lit(mark[0])) | (t <= F.lit(mark[1])))
    return source.where(upto & k.isNotNull()), mark


def poll_once(spark: SparkSession, source: DataFrame, key: str, target: str, state: str, *,
              max_rows: int | None = None, tie_break: str | None = None) -> int | None:
    """Append the next increment of ``source`` to ``target``; its number, or None when nothing is new.

    ``state`` is a folder that holds one mark per increment, written *before* the
    increment.  An increment goes to ``target/increment-<n>`` in overwrite mode,
    so whatever a poll that died has left is replaced by the same rows.  Read
    errors are errors: only a missing folder means a first run.  Read the target
    with ``recursiveFileLookup``.
    """
    marks, schema = _marks(spark, source, key, tie_break, state)
    last = max(marks, default=0)
    if last and not path_exists(spark, f"{target}/increment-{last:09d}/_SUCCESS"):
        n, before, mark = last, marks.get(last - 1), marks[last]        # the poll before died
        rows = _between(source, key, tie_break, before, mark)
    else:
        got = next_increment(source, key, marks.get(last), max_rows, tie_break)
        if got is None:
            return None
        n, (rows, mark) = last + 1, got
        spark.createDataFrame([(n, *mark)], schema).coalesce(1).write.mode("overwrite").parquet(f"{state}/mark-{n:09d}")
    rows.write.mode("overwrite").parquet(f"{target}/increment-{n:09d}")
    if n > 2:
        delete_path(spark, f"{state}/mark-{n - 2:09d}")     # the last two marks are all a restart needs
    return n


def _children(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mark-*")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def _between(source: DataFrame, key: str, tie_break: str | None, before: tuple | None, mark: tuple | None) -> DataFrame:
    """Rows behind ``before`` up to ``mark`` (None: without bound)."""
    k, rows = qcol(key), source
    if mark is not None:
        rows = source.where(k <= F.lit(mark[0]))
    if mark is not None and tie_break is not None:
        rows = rows.where((k < F.lit(mark[0])) | (qcol(tie_break) <= F.lit(mark[1])))
    if before is not None:
        behind = k > F.lit(before[0])
        if tie_break is not None:
            behind = behind | ((k == F.lit(before[0])) & (qcol(tie_break) > F.lit(before[1])))
        rows = rows.where(behind)
    return rows


def poll_backlog(spark: SparkSession, source: DataFrame, key: str, target: str, state: str, *,
                 max_rows: int | None = None, tie_break: str | None = None) -> int | None:
    """Append all that is new in ``source`` as one increment, in ranges of about ``max_rows`` rows; its number, or None.

    One aggregate over the rows behind the last mark tells where they end and how many they are; then a range partitioner
    (sampled splitters, so keys of any type) cuts them into ranges, each the work of one task and a file of its own.  No
    range is looked up by a scan of its own, and nothing is sorted in one place.  More than ``MAX_RANGES`` ranges are
    left for further increments.  Marks and restarts are those of ``poll_once``.
    """
    k, t = qcol(key), qcol(tie_break) if tie_break else F.lit(None).cast("int")
    marks, schema = _marks(spark, source, key, tie_break, state)
    last = max(marks, default=0)
    died = last and not path_exists(spark, f"{target}/increment-{last:09d}/_SUCCESS")
    before = marks.get(last - 1) if died else marks.get(last)
    open_rows = _between(source, key, tie_break, before, marks[last] if died else None)
    gap = k.isNull() if tie_break is None else k.isNull() | t.isNull()
    found = open_rows if died or before is None else open_rows.unionAll(source.where(gap))
    row = found.agg(F.max(F.struct(k.alias("k"), t.alias("t"))).alias("top"), F.count("*").alias("n"), F.count_if(gap).alias("gaps")).first()
    if row["gaps"]:
        raise ValueError(f"rows with a NULL in {[c for c in (key, tie_break) if c]} cannot be polled in order")
    if not row["n"] and not died:
        return None
    n, ranges = (last if died else last + 1), -(-row["n"] // max_rows) if max_rows else 1
    if not died:
        top = (row["top"]["k"], row["top"]["t"])
        if ranges > MAX_RANGES:
            top, ranges = _cut(open_rows, k, t, tie_break, MAX_RANGES / ranges) or top, MAX_RANGES
        spark.createDataFrame([(n, *top)], schema).coalesce(1).write.mode("overwrite").parquet(f"{state}/mark-{n:09d}")
        open_rows = _between(source, key, tie_break, before, top)
    if max_rows:
        open_rows = open_rows.repartitionByRange(max(min(ranges, MAX_RANGES), 1), *([k] if tie_break is None else [k, t]))
    open_rows.write.mode("overwrite").parquet(f"{target}/increment-{n:09d}")
    if n > 2:
        delete_path(spark, f"{state}/mark-{n - 2:09d}")
    return n


def _cut(rows: DataFrame, k, t, tie_break: str | None, share: float) -> tuple | None:
    """A mark with about ``share`` of the rows before it, from a bounded sample."""
    seen = rows.select(k.alias("k"), t.alias("t")).orderBy(F.rand(0)).limit(SAMPLE)
    at = sorted(((r["k"], r["t"]) for r in seen.collect()), key=lambda m: m if tie_break else m[:1])
    return at[min(int(share * len(at)), len(at) - 1)] if at else None


def _marks(spark: SparkSession, source: DataFrame, key: str, tie_break: str | None, state: str) -> tuple[dict, StructType]:
    types = field_types(source)
    schema = StructType([StructField("n", LongType()), StructField("k", types[key]),
                         StructField("t", types[tie_break] if tie_break else IntegerType())])
    have = path_exists(spark, state) and _children(spark, state)
    return ({r["n"]: (r["k"], r["t"]) for r in spark.read.schema(schema).parquet(f"{state}/mark-*").collect()} if have else {}), schema


def poll_table(spark: SparkSession, read_source: Callable[[], DataFrame], key: str,
               target: str, checkpoint: str, *, max_rows: int | None = None, tie_break: str | None = None,
               interval_seconds: float = POLL_SECONDS, duration_seconds: float | None = None,
               available_now: bool = False) -> None:
    """Poll any table (JDBC ones too) for new keys every interval and append them to ``target`` (R2).

    Each poll takes the whole backlog, cut into ranges of about ``max_rows`` rows (``poll_backlog``).  ``available_now``
    ends when nothing is new; otherwise polling goes on for ``duration_seconds``.  A restart with the same
    ``checkpoint`` goes on where the last poll stopped, and no row is appended twice.  Parquet tables can be
    polled as a stream: ``poll_stream``.
    """
    end = None if duration_seconds is None else time.monotonic() + duration_seconds
    while True:
        begin = time.monotonic()
        while poll_backlog(spark, read_source(), key, target, f"{checkpoint}/marks", max_rows=max_rows, tie_break=tie_break):
            pass
        if available_now or end is not None and time.monotonic() >= end:
            return
        pause = max(0.0, interval_seconds - (time.monotonic() - begin))
        time.sleep(pause if end is None else max(0.0, min(pause, end - time.monotonic())))


def poll_stream(spark: SparkSession, path: str, schema: StructType, key: str, target: str, checkpoint: str, *,
                max_rows: int | None = None, tie_break: str | None = None, transform: Callable[[DataFrame], DataFrame] | None = None,
                interval_seconds: float = POLL_SECONDS, duration_seconds: float | None = None,
                available_now: bool = False) -> StreamingQuery:
    """Poll a growing Parquet table as a stream and append its new rows to ``target``, each once.

    The source is ``sources.polled``: its offsets are key marks in the query's own checkpoint.  ``max_rows`` bounds a batch;
    ``available_now`` takes all there is.
    """
    stream = polled(spark, path, schema, key, checkpoint, max_rows=None if available_now else max_rows, tie_break=tie_break)
    return ingest(stream, target, checkpoint, transform=transform, available_now=available_now,
                  interval_seconds=interval_seconds, duration_seconds=duration_seconds)
