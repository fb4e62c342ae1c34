"""Big CSV files with line breaks inside values, read in splits.

A line break ends a record only outside quotes, and whether a byte is inside quotes
depends on every quote before it.  One pass counts the quotes of each byte range; their
prefix sums say how each range begins; a second pass cuts every range into records, each
record with the range it begins in.  Parsing stays Spark's (``from_csv``).

This holds for files as RFC 4180 has them: quotes stand around whole values and are
doubled inside.  The first pass also counts opening quotes that are not at the start of a
value; with any of these, with another encoding or with options that change what a quote or
line is, ``records`` returns None and the file has to be read whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT_BYTES = 64 << 20
#: What a task holds of a range at once (and the record that goes beyond it).
BLOCK_BYTES = 1 << 20
#: Options under which ranges of a file mean the same as the whole.
KNOWN = {"header", "multiline", "sep", "delimiter", "nullvalue", "emptyvalue", "dateformat", "timestampformat", "timestampntzformat",
         "ignoreleadingwhitespace", "ignoretrailingwhitespace", "nanvalue", "positiveinf", "negativeinf", "locale", "maxcharspercolumn", "maxcolumns"}
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".zip")

# the functions tasks run travel with the job: executors need not have this package
register_pickle_by_value(sys.modules[__name__])


def _at(f, start: int, end: int) -> bytes:
    f.seek(start)
    return f.read(end - start)


def _count(f, start: int, end: int, sep: int) -> tuple[int, int, int]:
    """Quotes in a range, and opening quotes not at the start of a value if the range begins outside or inside quotes."""
    import numpy as np
    n, odds, at = 0, [0, 0], start
    while at < end:
        before = _at(f, max(at - 1, 0), at)
        data = _at(f, at, min(at + BLOCK_BYTES, end))
        if not data:
            break
        x = np.frombuffer(before + data, np.uint8)
        q = np.flatnonzero(x[len(before):] == 34)
        prev = np.full(len(q), 10, np.uint8)
        near = q + len(before) - 1
        prev[near >= 0] = x[near[near >= 0]]
        odd = ~np.isin(prev, [10, 13, sep, 34])
        if not at and len(q) and q[0] == 3 and data[:3] == b"\xef\xbb\xbf":
            odd[0] = False
        odds[n % 2] += int(odd[::2].sum())
        odds[1 - n % 2] += int(odd[1::2].sum())
        n += len(q)
        at += len(data)
    return n, odds[0], odds[1]


def _cut(f, start: int, end: int, size: int, inside: int, header: bool) -> Iterator[list[bytes]]:
    """The records that begin in a range, those of a block at a time."""
    import numpy as np
    head = _at(f, start - 1, start) if start else b"\n"
    begun, parity, at, rest, first = head == b"\n" and not inside, inside, start, [], start == 0

    def done(last: bytes) -> list[bytes]:
        nonlocal first, rest
        r, rest = b"".join([*rest, last]).removesuffix(b"\r"), []
        if first:
            first, r = False, b"" if header else r.removeprefix(b"\xef\xbb\xbf")
        return [r] if r else []

    f.seek(start)
    while at < end or begun and at < size:
        data = f.read(min(BLOCK_BYTES, (end if at < end else size) - at))
        if not data:
            break
        x = np.frombuffer(data, np.uint8)
        quotes, breaks = np.flatnonzero(x == 34), np.flatnonzero(x == 10)
        ends = breaks[(parity + np.searchsorted(quotes, breaks)) % 2 == 0]
        parity = (parity + len(quotes)) % 2
        out, lo, behind = [], 0, at >= end
        for e in ends[:1].tolist() if behind else ends.tolist():
            if begun:
                out += done(data[lo:e])
            begun, lo = not behind, e + 1
        at += len(data)
        if at == end and lo == len(data):       # the next record begins in the next range
            begun = False
        if begun:
            rest.append(data[lo:])
        if out:
            yield out
    if begun and (out := done(b"")):
        yield out


def records(spark: SparkSession, listing: DataFrame, *, header: bool, sep: str = ",", split_bytes: int = SPLIT_BYTES) -> DataFrame | None:
    """(value): the records of the listed objects (path, Size), without headers; None if quotes are not as they should be."""
    from ..session import scratch_path
    from .files import open_fs
    mark = ord(sep)
    ranges = listing.where("Size > 0").select("path", "Size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("Size") - 1, F.lit(split_bytes).cast("long"))).alias("start")) \
        .withColumn("end", F.least(F.col("start") + split_bytes, "Size"))
    n = max(1, min(ranges.count(), 100_000))

    def count(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for path, _, start, end in zip(*(c.to_pylist() for c in b.columns)):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    out.append(_count(f, start, end, mark))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in cols)], ["path", "Size", "start", "end", "quotes", "odd0", "odd1"])

    counted = ranges.repartition(n).mapInArrow(count, "path string, Size long, start long, end long, quotes long, odd0 long, odd1 long")
    counted.write.parquet(written := scratch_path(spark, "csv-ranges"))
    before = F.sum("quotes").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    begun = spark.read.parquet(written).withColumn("inside", F.coalesce(before, F.lit(0)) % 2)
    if begun.agg(F.sum(F.when(F.col("inside") == 0, F.col("odd0")).otherwise(F.col("odd1")))).first()[0]:
        return None

    def cut(batches):
        import pyarrow as pa
        for b in batches:
            for path, size, start, end, inside in zip(*(c.to_pylist() for c in b.columns)):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    for rows in _cut(f, start, end, size, inside, header):
                        for lo in range(0, len(rows), 10_000):
                            yield pa.RecordBatch.from_arrays([pa.array(rows[lo:lo + 10_000], pa.binary()).cast(pa.string())], ["value"])

    return begun.select("path", "Size", "start", "end", "inside").repartition(n).mapInArrow(cut, "value string")


def splittable(path: str, options: dict) -> bool:
    """Whether a file can be read by ranges under these reader options."""
    sep = str(options.get("sep", options.get("delimiter", ",")))
    return (not path.lower().endswith(PACKED) and {k.lower() for k in options} <= KNOWN and len(sep.encode()) == 1 and sep not in '"\r\n')
