"""Deduplication of a stream that keeps a defined row (P2 on streams).

A key's rows, in order of event time (ties by ``order``), open *episodes*: the first row
is kept, rows less than ``within`` after it are dropped, the next one is kept, and so
on.  NULL keys are equal to each other.  A row's fate is decided when the watermark
has passed it, since only then nothing earlier can come; until then it waits in the
state of its key.  So the result depends on the rows alone, not on how they fall into
files and micro-batches, as long as no row is later than ``lateness``.

The state is Spark's own, in two steps.  Rows wait in an aggregate by key and event time (of rows equal in both only the
first by ``order`` can be kept), which gives them out when the watermark has passed them; no Python sees them before.
``transformWithState`` then decides them: all it keeps of a key is the event time of the row kept last, which goes once
``within`` has passed.  Keys are dealt to ``BUCKETS`` buckets that are read and written as one.  Nothing written before is
ever read again.  State of this kind needs the RocksDB provider, which is set for the query alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from ..functions.columns import field_types, qcol, quote

PARTITIONS_KEY = "spark.sql.shuffle.partitions"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time (for the watermark), the same in microseconds, and the tie-break.
TIME, AT, TIE = "__event_time", "__at", "__tie"
#: A waiting row, in the state.
ROW = "__row"
#: Keys share state by a hash, since every state call is a message between the worker and Spark.  The number is part of a checkpoint.
BUCKET, BUCKETS = "__bucket", 1 << 11
#: The two steps as Spark numbers them in the checkpoint, from the last one back.
DECIDED, WAITING = 0, 1

# the functions tasks run travel with the job: executors need not have this package
register_pickle_by_value(sys.modules[__name__])


def decide(rows: list[tuple], last: int | None, within: int) -> tuple[list[tuple], int | None]:
    """Rows (sorted; event time in microseconds and tie-break last) that are kept, and the event time of the last one."""
    kept = []
    for row in rows:
        t = row[-2]
        if last is None or not last <= t < last + within:
            kept.append(row)
            last = t
    return kept, last


def _place(row: tuple) -> tuple:
    return row[-2:]


def _due(t: int) -> int:
    """The watermark (ms) from which on nothing as early as ``t`` can come any more."""
    return t // 1000 + 1


def _same(value):
    """A value that is equal and hashes alike for equal keys (NULL and NaN are equal to themselves)."""
    if isinstance(value, float) and value != value:
        return (float,)
    if isinstance(value, (list, tuple)):
        return tuple(map(_same, value))
    return bytes(value) if isinstance(value, bytearray) else value


class FirstWithin(StatefulProcessor):
    """Episodes of the keys of one bucket, from rows that the watermark has passed.

    ``keys``: where the key columns lie in a row.  The state is read and written once a bucket and batch; an entry goes when
    its episode is over and the bucket has rows again, or when all episodes of the bucket are over.
    """

    def __init__(self, schema: StructType, keys: list[int], within: int):
        self.schema, self.keys, self.within = schema, keys, within

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", StructType(
            [*(StructField(f"k{i}", self.schema.fields[k].dataType) for i, k in enumerate(self.keys)), StructField("t", LongType())]))
        self.named = Row(*self.schema.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        before = {_same(e[:-1]): e for e in map(tuple, self.last.get())}
        found: dict = {}
        for r in rows:
            row = tuple(r)[:len(self.schema)]
            found.setdefault(_same(tuple(row[k] for k in self.keys)), []).append(row)
        after, out = dict(before), []
        for k, mine in found.items():
            kept, last = decide(sorted(mine, key=_place), before[k][-1] if k in before else None, self.within)
            out += kept
            after[k] = (*(mine[0][i] for i in self.keys), last)
        self._keep(before, after, timerValues.getCurrentWatermarkInMs(), not before)
        return (self.named(*row) for row in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        before = dict(enumerate(map(tuple, self.last.get())))
        self._keep(before, before, timerValues.getCurrentWatermarkInMs(), True)
        return iter(())

    def _keep(self, before: dict, after: dict, now: int, timer: bool) -> None:
        ends = {k: end for k, e in after.items() if (end := _due(e[-1] + self.within)) > now}
        if not ends:
            if before:
                self.last.clear()
            return
        if len(ends) < len(before) or any(k not in before or before[k][-1] != after[k][-1] for k in ends):
            self.last.put([after[k] for k in ends])
        if timer:       # otherwise one is set already, and goes on to the end of the last episode when it is due
            self.handle.registerTimer(max(ends.values()))

    def close(self) -> None:
        pass


def micros(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + interval {interval})")).first()[0]


def _stamps(schema: StructType) -> set[str]:
    return {f.name for f in schema.fields if isinstance(f.dataType, TimestampType)}


def _timed(stream: DataFrame, event_time: str, order: Sequence[str]) -> DataFrame:
    """The stream's columns (timestamps as microseconds, which no time zone moves), event time in microseconds, tie-break
    and event time; rows without an event time raise."""
    t = qcol(event_time).cast("timestamp")
    t = F.when(t.isNull(), F.raise_error(F.lit(f"a row without {event_time} has no place in the order")).cast("timestamp")).otherwise(t)
    kinds, stamps = field_types(stream), _stamps(stream.schema)
    tie = [qcol(c) for c in order] or [qcol(c) for c, k in kinds.items() if k.typeName() != "map"]
    tie = tie[0].cast("long") if len(order) == 1 and kinds[order[0]].typeName() in ("long", "integer") else F.xxhash64(*tie)
    own = [F.unix_micros(qcol(c)).alias(c) if c in stamps else qcol(c) for c in stream.columns]
    return stream.select(*own, F.unix_micros(t).alias(AT), F.coalesce(tie, F.lit(-1 << 63)).alias(TIE), t.alias(TIME))


def _plain(rows: DataFrame, schema: StructType) -> DataFrame:
    """The stream's own columns again."""
    stamps = _stamps(schema)
    return rows.select(*[F.timestamp_micros(qcol(c)).alias(c) if c in stamps else qcol(c) for c in schema.names])


def dedup_first(stream: DataFrame, columns: Sequence[str], event_time: str, *, within: str, lateness: str = "10 minutes",
                order: Sequence[str] = ()) -> DataFrame:
    """The first row of each episode of ``within`` of a key (``columns``), emitted when the watermark passes it.

    ``order``: columns that tell rows of one event time apart; by default a hash of the row.  Rows later than
    ``lateness`` are dropped, as by any watermark.  Start the query inside ``state_settings(spark)`` or with the
    RocksDB provider set.
    """
    timed = _timed(stream, event_time, order).withWatermark(TIME, lateness)
    schema = StructType(timed.schema.fields[:-1])
    span = micros(stream.sparkSession, within)
    if span <= 0:       # no row is another's duplicate
        return _plain(timed, stream.schema)
    process = FirstWithin(schema, [schema.names.index(c) for c in columns], span)
    own = [qcol(c) for c in schema.names]
    passed = timed.groupBy(*[qcol(c) for c in columns], TIME).agg(F.min_by(F.struct(*own), TIE).alias(ROW)).select(f"{ROW}.*", TIME)
    passed = passed.withColumn(BUCKET, F.pmod(F.xxhash64(*[qcol(c) for c in columns]), F.lit(BUCKETS)).cast("int"))
    return _plain(passed.groupBy(BUCKET).transformWithState(process, schema, "append", "eventtime"), stream.schema)


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """What ``dedup_first`` needs, for queries started inside (a query takes the settings of its start along): the RocksDB
    provider, and no more state partitions than the cluster can work on in two rounds."""
    partitions = min(int(spark.conf.get(PARTITIONS_KEY)), 2 * spark.sparkContext.defaultParallelism)
    new = {PROVIDER_KEY: ROCKSDB, PARTITIONS_KEY: str(partitions)}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def waiting_rows(spark: SparkSession, checkpoint: str, schema: StructType, columns: Sequence[str], within: str) -> DataFrame:
    """The rows of a stream (of ``schema``) that would be kept if nothing more came: decided from the state a query left.

    For a stream that has ended.  A query that goes on with the checkpoint emits the same rows itself in time.
    """
    def state(operator: int, **options: str) -> DataFrame:
        return spark.read.format("statestore").option("operatorId", operator).options(**options).load(checkpoint)

    waits = state(WAITING)
    waits = waits.select(F.col(f"value.{waits.schema['value'].dataType.names[0]}").alias("row"))
    held = waits.groupBy(*[F.col(f"row.{quote(c)}").alias(f"k{i}") for i, c in enumerate(columns)]).agg(F.sort_array(F.collect_list(F.struct(
        F.col(f"row.{AT}").alias("t"), F.col(f"row.{TIE}").alias("tie"), F.col("row")))).alias("rows")).alias("h")
    last = state(DECIDED, stateVarName="last", flattenCollectionTypes="true").select("list_element.*").withColumnRenamed("t", "last").alias("l")
    same = [F.col(f"h.k{i}").eqNullSafe(F.col(f"l.k{i}")) for i in range(len(columns))]
    both = held.join(last, reduce(and_, same), "left")
    begin = F.struct(F.col("last").alias("last"), F.slice("rows", 1, 0).alias("kept"))
    done = F.aggregate("rows", begin, lambda a, x: F.when(
        a["last"].isNull() | (x["t"] < a["last"]) | (x["t"] >= a["last"] + micros(spark, within)),
        F.struct(x["t"].alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a))
    return _plain(both.select(F.explode(done["kept"]).alias("x")).select("x.row.*"), schema)
