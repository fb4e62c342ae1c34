"""A growing Parquet table as a streaming source.

``spark.readStream.format("polled_parquet")`` gives the rows of a table in the order of a
key that grows, each once.  Offsets are marks, (key, tie-break) pairs, and live where
Spark keeps the offsets of every source: in the query's checkpoint.  A batch is planned
from the footers of the table's files alone: the row groups whose keys lie behind the
mark, ordered by their ends, up to about ``max_rows`` rows.  Each of these row groups is a
partition of the batch, read by a task of its own with the marks as a filter; no row
passes through the driver.

Rows with a NULL key have no place in the order and raise.  Rows that arrive later under
a key already passed are only found when a ``tie_break`` column tells the rows of a key
apart; without one a batch always ends with the last row of a key.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import qualified
from .files import open_fs

FORMAT = "polled_parquet"

# the functions tasks run travel with the job: executors need not have this package
register_pickle_by_value(sys.modules[__name__])

_KINDS = {"int": int, "float": float, "str": str, "Decimal": Decimal, "date": date.fromisoformat, "datetime": datetime.fromisoformat}


def spell(value) -> str:
    """A key value as text that ``told`` reads back exactly."""
    if isinstance(value, datetime):
        return f"datetime:{value.isoformat()}"
    if isinstance(value, date):
        return f"date:{value.isoformat()}"
    name = type(value).__name__
    if name not in _KINDS:
        raise TypeError(f"a key of type {name} cannot be polled")
    return f"{name}:{value!r}" if isinstance(value, float) else f"{name}:{value}"


def told(text: str):
    name, _, value = text.partition(":")
    return _KINDS[name](value)


def mark(offset: dict) -> tuple | None:
    """(key, tie-break or None) of an offset; None before the first row."""
    if not offset.get("key"):
        return None
    return told(offset["key"]), told(offset["tie"]) if offset.get("tie") else None


@dataclass
class RowGroup(InputPartition):
    """A stretch of a file, and the marks that bound what is wanted of it."""

    path: str
    number: int
    after: tuple | None
    upto: tuple


class PolledParquet(DataSource):
    """Options: path, schema (JSON), key, tie_break, max_rows, checkpoint (of the query, to go on from its last offset)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["schema"]))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PolledReader(dict(self.options), schema)


class PolledReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.uri, self.key, self.tie = options["path"], options["key"], options.get("tie_break") or None
        self.max_rows, self.columns, self.schema = int(options.get("max_rows") or 0), schema.names, schema
        self.now = last_offset(options["checkpoint"]) if options.get("checkpoint") else {}
        self.groups: dict[str, list[tuple]] = {}

    def initialOffset(self) -> dict:
        return {"key": "", "tie": ""}

    def latestOffset(self) -> dict:
        """The mark that ends the next batch."""
        after = mark(self.now)
        ends = []
        for groups in self.footers().values():
            for rows, _, high, gaps in groups:
                if gaps:
                    raise ValueError(f"rows with a NULL in {self.key!r} cannot be polled in order")
                if after is None or high > after[0] or self.tie and high == after[0]:
                    ends.append((high, rows))
        if not ends:
            return self.now or self.initialOffset()
        ends.sort(key=lambda e: e[0])
        end, total = ends[-1][0], 0
        for high, rows in ends if self.max_rows else ():
            total += rows
            if total >= self.max_rows:
                end = high
                break
        tie = self.last_tie(end) if self.tie else None
        if after is not None and (end, tie) == after:
            return self.now
        self.now = {"key": spell(end), "tie": spell(tie) if self.tie else ""}
        return self.now

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        after, upto = mark(start), mark(end)
        if upto is None or start == end:
            return []
        self.now = end
        return [RowGroup(path, i, after, upto) for path, groups in self.footers().items() for i, (_, low, high, _) in enumerate(groups)
                if low is not None and low <= upto[0] and (after is None or high > after[0] or self.tie and high == after[0])]

    def read(self, partition: RowGroup) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        fs, path = open_fs(partition.path)
        kinds = to_arrow_schema(self.schema)
        wanted = list(dict.fromkeys([*self.columns, self.key, *([self.tie] if self.tie else [])]))
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(row_groups=[partition.number], columns=wanted):
                t = pa.Table.from_batches([b])
                keep = self.not_after(pc, t, partition.upto)
                if partition.after is not None:
                    keep = pc.and_(keep, pc.invert(self.not_after(pc, t, partition.after)))
                yield from t.filter(keep).select(self.columns).cast(kinds, safe=False).to_batches()

    def not_after(self, pc, table, upto: tuple):
        """Rows up to a mark."""
        import pyarrow as pa

        def scalar(column, value):
            return pa.scalar(value, column.type)

        k = table.column(self.key)
        if not self.tie:
            return pc.less_equal(k, scalar(k, upto[0]))
        t = table.column(self.tie)
        here = pc.and_(pc.equal(k, scalar(k, upto[0])), pc.less_equal(t, scalar(t, upto[1])))
        return pc.or_(pc.less(k, scalar(k, upto[0])), here)

    def footers(self) -> dict[str, list[tuple]]:
        """{file: [(rows, least key, greatest key, NULL keys)]}; a file's footer is read once."""
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs
        fs, top = open_fs(self.uri)
        here = {}
        for i in fs.get_file_info(pafs.FileSelector(top, recursive=True)):
            if i.type == pafs.FileType.File and i.base_name.endswith(".parquet") and not i.base_name.startswith(("_", ".")) and "/_temporary/" not in i.path:
                path = self.uri.rstrip("/") + i.path[len(top.rstrip("/")):]
                if path not in self.groups:
                    with fs.open_input_file(i.path) as f:
                        self.groups[path] = list(self.spans(pq.ParquetFile(f)))
                here[path] = self.groups[path]
        self.groups = here
        return here

    def spans(self, file) -> Iterator[tuple]:
        for i in range(file.metadata.num_row_groups):
            group = file.metadata.row_group(i)
            leaf = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == self.key)
            # old timestamps (INT96) have no statistics that can be read
            stats = None if leaf.physical_type == "INT96" else leaf.statistics
            if stats is not None and stats.has_min_max and stats.null_count == 0:
                yield group.num_rows, stats.min, stats.max, 0
            else:  # the key column itself
                column = file.read_row_group(i, columns=[self.key]).column(0)
                values = column.drop_null().to_pylist()
                yield group.num_rows, min(values, default=None), max(values, default=None), column.null_count

    def last_tie(self, key):
        """The greatest tie-break of a key."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        best = None
        for path, groups in self.footers().items():
            fs, at = open_fs(path)
            for i, (_, low, high, _) in enumerate(groups):
                if low is not None and low <= key <= high:
                    with fs.open_input_file(at) as f:
                        t = pq.ParquetFile(f).read_row_group(i, columns=[self.key, self.tie])
                    ties = t.filter(pc.equal(t.column(self.key), key)).column(self.tie)
                    if ties.null_count:
                        raise ValueError(f"rows with a NULL in {self.tie!r} cannot be polled in order")
                    top = pc.max(ties).as_py()
                    best = top if best is None or top is not None and top > best else best
        return best


def last_offset(checkpoint: str) -> dict:
    """The newest offset that Spark has written for a query with one source; {} for a new query."""
    from pyarrow import fs as pafs
    fs, top = open_fs(checkpoint)
    info = fs.get_file_info(pafs.FileSelector(f"{top}/offsets", allow_not_found=True))
    numbers = sorted(int(i.base_name) for i in info if i.base_name.isdigit())
    if not numbers:
        return {}
    with fs.open_input_stream(f"{top}/offsets/{numbers[-1]}") as f:
        return json.loads(f.read().decode().splitlines()[-1])


def polled(spark: SparkSession, path: str, schema: StructType, key: str, checkpoint: str, *, max_rows: int | None = None,
           tie_break: str | None = None) -> DataFrame:
    """A streaming DataFrame over the rows of a Parquet table in the order of ``key``; ``checkpoint`` is the query's."""
    spark.dataSource.register(PolledParquet)
    options = {"path": qualified(spark, path), "schema": schema.json(), "key": key, "checkpoint": qualified(spark, checkpoint),
               "max_rows": str(max_rows or 0), "tie_break": tie_break or ""}
    return spark.readStream.format(FORMAT).options(**options).load()
