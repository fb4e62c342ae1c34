"""Stored tables: edits touch only the files that hold the keys."""

import os

import pytest
from pyspark.sql import functions as F

from scour.operators import edits


def state(path):
    """{file: (time, bytes)} of all data files."""
    out = {}
    for d, _, names in os.walk(f"{path}/data"):
        for n in names:
            if n.endswith(".parquet"):
                f = os.path.join(d, n)
                out[f] = (os.stat(f).st_mtime_ns, open(f, "rb").read())
    return out


def table(spark, path, partition_by=()):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.concat(F.lit("a b+"), (F.col("id") % 3).cast("string")).alias("g"))
    edits.store(df.repartitionByRange(5, "k"), path, partition_by)
    return {r.k: (r.v, r.g) for r in df.collect()}


@pytest.mark.parametrize("partition_by", [(), ("g",)])
def test_update_then_delete(spark, tmp_dir, partition_by):
    path = tmp_dir + "/my table"
    want, before = table(spark, path, partition_by), None
    before = state(path)
    changes = spark.createDataFrame([(7, 70), (9, 90), (5000, 1)], "k long, v long")
    got = edits.update_stored(spark, path, changes, "k")
    want[7], want[9] = (70, want[7][1]), (90, want[9][1])
    assert (got.rows, got.version) == (2, 2) and 0 < got.rewritten <= 2 and got.rewritten + got.untouched == len(before)
    assert {r.k: (r.v, r.g) for r in edits.read_stored(spark, path).collect()} == want
    got = edits.delete_stored(spark, path, [9, 50], "k")
    del want[9], want[50]
    assert got.rows == 2 and got.version == 3
    rows = edits.read_stored(spark, path)
    assert rows.columns == ["k", "v", "g"] and {r.k: (r.v, r.g) for r in rows.collect()} == want
    after = state(path)
    assert all(after[f] == x for f, x in before.items())     # nothing was written over
    assert {r.k: r.v for r in edits.read_stored(spark, path, 1).collect()}[7] == 14
    gone = edits.drop_versions(spark, path)
    assert gone > 0 and edits.versions(spark, path) == [3] and len(state(path)) == len(after) - gone
    assert {r.k: (r.v, r.g) for r in edits.read_stored(spark, path).collect()} == want


def test_not_found_changes_nothing_and_all_rows_may_go(spark, tmp_dir):
    path = tmp_dir + "/t"
    table(spark, path)
    assert edits.delete_stored(spark, path, [1000], "k") == edits.Edit(0, 0, 5, 1)
    edits.delete_stored(spark, path, spark.range(100).select(F.col("id").alias("k")), "k")
    assert edits.read_stored(spark, path).count() == 0
    assert edits.delete_stored(spark, path, [1], "k").rows == 0
    with pytest.raises(ValueError, match="already"):
        edits.store(spark.range(3), path)
    with pytest.raises(ValueError, match="no version"):
        edits.read_stored(spark, path, 9)
    with pytest.raises(ValueError):
        edits.read_stored(spark, tmp_dir + "/none")


def test_an_edit_that_died_leaves_the_version_before(spark, tmp_dir, monkeypatch):
    path = tmp_dir + "/t"
    want = table(spark, path)
    monkeypatch.setattr(edits, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        edits.delete_stored(spark, path, [3], "k")
    monkeypatch.undo()
    assert {r.k: (r.v, r.g) for r in edits.read_stored(spark, path).collect()} == want
    assert edits.delete_stored(spark, path, [3], "k").rows == 1 and edits.read_stored(spark, path).count() == 99
