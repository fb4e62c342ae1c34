import os
import random
import sys

import pytest

from pyspark.sql import functions as F

from scour.operators import cleaning
from scour.streaming import dedup_ingest, file_stream, ingest, next_increment, poll_backlog, poll_once, poll_stream, poll_table


def test_file_ingest_available_now_matches_batch(spark, tmp_dir):
    src = tmp_dir + "/in"
    df = spark.range(100).selectExpr("id", "case when id % 3 = 0 then null else id * 1.5 end v")
    df.repartition(4).write.parquet(src)
    stream = file_stream(spark, src, "parquet", df.schema, max_files_per_trigger=1)
    ingest(stream, tmp_dir + "/out", tmp_dir + "/ckpt", available_now=True,
           transform=lambda s: cleaning.fill_na(cleaning.filter_rows(s, "id > 10"), 0.0))
    out = spark.read.parquet(tmp_dir + "/out")
    batch = cleaning.fill_na(cleaning.filter_rows(df, "id > 10"), 0.0)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
    # new files arrive: only they are ingested on the next run
    spark.range(100, 110).selectExpr("id", "id * 1.5 v").write.mode("append").parquet(src)
    ingest(file_stream(spark, src, "parquet", df.schema), tmp_dir + "/out", tmp_dir + "/ckpt",
           available_now=True)
    assert spark.read.parquet(tmp_dir + "/out").count() == 89 + 10


def test_increments_take_whole_keys(spark):
    src = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e")], "k int, v string")
    seen, mark = [], None
    while got := next_increment(src, "k", mark, max_rows=3):
        rows, mark = got
        seen.append(sorted(r.v for r in rows.collect()))
    assert seen == [["a", "b", "c", "d"], ["e"]]
    seen, mark = [], None
    while got := next_increment(src, "k", mark, max_rows=3, tie_break="v"):
        rows, mark = got
        seen.append(sorted(r.v for r in rows.collect()))
    assert seen == [["a", "b", "c"], ["d", "e"]]
    with pytest.raises(ValueError, match="NULL"):
        next_increment(src.unionByName(spark.createDataFrame([(None, "z")], "k int, v string")), "k", (3, None))


def polled(spark, path):
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def test_poll_table_takes_everything_once(spark, tmp_dir):
    src = tmp_dir + "/table"
    spark.range(30).selectExpr("id div 4 as k", "id").write.parquet(src)
    read = lambda: spark.read.parquet(src)
    assert poll_table(spark, read, "k", tmp_dir + "/tgt", tmp_dir + "/ck", max_rows=10, available_now=True) is None
    assert sorted(r.id for r in polled(spark, tmp_dir + "/tgt").collect()) == list(range(30))
    spark.range(30, 41).selectExpr("id + 100 as k", "id").write.mode("append").parquet(src)
    poll_table(spark, read, "k", tmp_dir + "/tgt", tmp_dir + "/ck", max_rows=4, available_now=True)     # a restart
    poll_table(spark, read, "k", tmp_dir + "/tgt", tmp_dir + "/ck", max_rows=4, available_now=True)     # nothing new
    assert sorted(r.id for r in polled(spark, tmp_dir + "/tgt").collect()) == list(range(41))


def test_poll_table_on_a_clock(spark, tmp_dir):
    src = tmp_dir + "/table"
    spark.range(12).write.parquet(src)
    poll_table(spark, lambda: spark.read.parquet(src), "id", tmp_dir + "/tgt", tmp_dir + "/ck",
               max_rows=6, interval_seconds=0.5, duration_seconds=2)
    assert sorted(r.id for r in polled(spark, tmp_dir + "/tgt").collect()) == list(range(12))


def test_a_poll_that_died_is_done_again_with_the_same_rows(spark, tmp_dir, monkeypatch):
    src = spark.range(10).selectExpr("id", "id % 2 as p")
    assert poll_once(spark, src, "id", tmp_dir + "/t", tmp_dir + "/s", max_rows=4) == 1
    assert poll_once(spark, src, "id", tmp_dir + "/t", tmp_dir + "/s", max_rows=4) == 2
    os.remove(tmp_dir + "/t/increment-000000002/_SUCCESS")      # as if it had stopped half-way
    late = src.unionByName(spark.createDataFrame([(100, 0)], "id bigint, p bigint"))
    assert poll_once(spark, late, "id", tmp_dir + "/t", tmp_dir + "/s", max_rows=4) == 2
    assert sorted(r.id for r in polled(spark, tmp_dir + "/t").collect()) == list(range(8))
    while poll_once(spark, late, "id", tmp_dir + "/t", tmp_dir + "/s", max_rows=1):
        pass
    assert sorted(r.id for r in polled(spark, tmp_dir + "/t").collect()) == [*range(10), 100]


def test_an_unreadable_state_is_an_error_not_a_first_run(spark, tmp_dir):
    src = spark.range(5)
    poll_once(spark, src, "id", tmp_dir + "/t", tmp_dir + "/s")
    for d in os.listdir(tmp_dir + "/s"):
        for f in os.listdir(f"{tmp_dir}/s/{d}"):
            if f.endswith(".parquet"):
                with open(f"{tmp_dir}/s/{d}/{f}", "wb") as out:
                    out.write(b"broken")
    with pytest.raises(Exception):
        poll_once(spark, src, "id", tmp_dir + "/t", tmp_dir + "/s")
    assert polled(spark, tmp_dir + "/t").count() == 5


def test_dedup_ingest_over_batches(spark, tmp_dir):
    src = tmp_dir + "/in"
    for i in range(3):
        spark.range(100).selectExpr(f"id % {20 + 5 * i} as k", "timestamp_seconds(1700000000 + id) as ts") \
            .coalesce(1).write.mode("append").parquet(src)
    stream = file_stream(spark, src, "parquet", spark.read.parquet(src).schema, max_files_per_trigger=1)
    dedup_ingest(stream, ["k"], "ts", tmp_dir + "/out", tmp_dir + "/ck", delay="1 day", available_now=True, close=True)
    assert sorted(r.k for r in polled(spark, tmp_dir + "/out").collect()) == list(range(30))


def greedy(rows, within):
    """rows: (key, seconds, n); the (key, n) kept by hand."""
    kept, last = [], {}
    for k, t, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] >= within:
            kept.append((k, n))
            last[k] = t
    return sorted(kept, key=str)


@pytest.mark.parametrize("cuts", [(), (40,), (10, 20, 55)])
def test_what_dedup_keeps_does_not_depend_on_files(spark, tmp_dir, cuts):
    rng = random.Random(4)
    rows = [(rng.choice([None, None, 1, 2, 3]), 100 * i + rng.randint(0, 300), i) for i in range(80)]
    src, ends = tmp_dir + "/in", [0, *cuts, 80]
    for a, z in zip(ends, ends[1:]):
        part = rows[a:z]
        rng.shuffle(part)
        spark.createDataFrame(part, "k long, s long, n long").selectExpr("k", "timestamp_seconds(1700000000 + s) as ts", "n") \
            .coalesce(1).write.mode("append").parquet(src)
    stream = file_stream(spark, src, "parquet", spark.read.parquet(src).schema, max_files_per_trigger=1)
    dedup_ingest(stream, ["k"], "ts", tmp_dir + "/out", tmp_dir + "/ck", delay="15 minutes", lateness="5 minutes", order=["n"],
                 available_now=True, close=True)
    got = polled(spark, tmp_dir + "/out")
    assert sorted(((r.k, r.n) for r in got.collect()), key=str) == greedy(rows, 900)
    assert got.where("ts <> timestamp_seconds(1700000000 + 0) and ts is null").count() == 0
    times = {r.n: r.s for r in got.selectExpr("n", "unix_seconds(ts) - 1700000000 as s").collect()}
    assert all(times[n] == s for _, s, n in rows if n in times)


def test_python_keeps_no_waiting_rows(spark, tmp_dir):
    rows = [(k, 60 * i, 100 * i + j) for i in range(30) for k in (None, 1, 2) for j in (1, 0)]     # two rows of a key at every time
    spark.createDataFrame(rows, "k long, s long, n long").selectExpr("k", "timestamp_seconds(1700000000 + s) as ts", "n").coalesce(1).write.parquet(tmp_dir + "/in")
    stream = file_stream(spark, tmp_dir + "/in", "parquet", spark.read.parquet(tmp_dir + "/in").schema)
    dedup_ingest(stream, ["k"], "ts", tmp_dir + "/out", tmp_dir + "/ck", delay="5 minutes", lateness="5 minutes", order=["n"], available_now=True, close=True)
    assert sorted(((r.k, r.n) for r in polled(spark, tmp_dir + "/out").collect()), key=str) == greedy(rows, 300)
    state = {r.operatorName: r.operatorProperties for r in spark.read.format("state-metadata").load(tmp_dir + "/ck").collect()}
    assert set(state) == {"transformWithStateInPySparkExec", "stateStoreSave"} and "held" not in state["transformWithStateInPySparkExec"]
    last = spark.read.format("statestore").option("stateVarName", "last").option("flattenCollectionTypes", "true").load(tmp_dir + "/ck")
    assert last.count() <= 3        # one entry a bucket: one time a key, and only of episodes that are open
    dedup_ingest(stream, ["k"], "ts", tmp_dir + "/all", tmp_dir + "/ck0", delay="0 seconds", available_now=True, close=True)
    assert polled(spark, tmp_dir + "/all").count() == len(rows)        # no row is another's duplicate


def test_rows_without_an_event_time_raise(spark, tmp_dir):
    spark.sql("select 1 as k, cast(null as timestamp) as ts").write.parquet(tmp_dir + "/in")
    stream = file_stream(spark, tmp_dir + "/in", "parquet", spark.read.parquet(tmp_dir + "/in").schema)
    with pytest.raises(Exception, match="without ts"):
        dedup_ingest(stream, ["k"], "ts", tmp_dir + "/out", tmp_dir + "/ck", available_now=True)


def test_a_backlog_is_cut_into_ranges(spark, tmp_dir, monkeypatch):
    src = spark.range(1000).selectExpr("id div 3 as k", "id").repartition(5)
    assert poll_backlog(spark, src, "k", tmp_dir + "/t", tmp_dir + "/s", max_rows=100) == 1
    files = spark.read.parquet(tmp_dir + "/t/increment-000000001").groupBy(F.input_file_name()).agg(
        F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("z")).orderBy("a").collect()
    assert 5 <= len(files) <= 10 and all(x.z < y.a for x, y in zip(files, files[1:])) and sum(f.n for f in files) == 1000
    assert poll_backlog(spark, src, "k", tmp_dir + "/t", tmp_dir + "/s", max_rows=100) is None
    more = src.unionByName(spark.range(50).selectExpr("400 + id as k", "5000 + id as id"))
    monkeypatch.setattr(sys.modules["scour.streaming.ingest"], "MAX_RANGES", 2)     # a backlog of more ranges takes several increments
    n = 0
    while poll_backlog(spark, more, "k", tmp_dir + "/t", tmp_dir + "/s", max_rows=10):
        n += 1
    assert n > 1 and sorted(r.id for r in polled(spark, tmp_dir + "/t").collect()) == [*range(1000), *range(5000, 5050)]
    with pytest.raises(ValueError, match="NULL"):
        poll_backlog(spark, more.unionByName(spark.sql("select cast(null as bigint) k, 1L id")), "k", tmp_dir + "/t", tmp_dir + "/s")


@pytest.mark.parametrize("kind", ["bigint", "string", "date", "timestamp", "decimal(20,2)"])
def test_poll_stream_takes_every_row_once_over_restarts(spark, tmp_dir, kind):
    key = {"bigint": "id div 4", "string": "lpad(id div 4, 6, '0')", "date": "date_add(date'2024-01-01', int(id div 4))",
           "timestamp": "timestamp_seconds(1700000000 + id div 4)", "decimal(20,2)": "cast(id div 4 as decimal(20,2))"}[kind]
    rows = spark.range(120).selectExpr(f"{key} as k", "id")
    src, take = tmp_dir + "/src", lambda: poll_stream(spark, src, rows.schema, "k", tmp_dir + "/out", tmp_dir + "/ck", available_now=True)
    for lo, hi in ((0, 40), (40, 44), (44, 120)):
        rows.where((F.col("id") >= lo) & (F.col("id") < hi)).repartition(3).write.mode("append").parquet(src)
        take()
        take()
    assert sorted(r.id for r in spark.read.parquet(tmp_dir + "/out").collect()) == list(range(120))


def test_poll_stream_in_bounded_batches(spark, tmp_dir):
    src = tmp_dir + "/src"
    rows = spark.range(100).selectExpr("id div 10 as k", "id")
    rows.repartitionByRange(10, "id").write.parquet(src)
    q = poll_stream(spark, src, rows.schema, "k", tmp_dir + "/out", tmp_dir + "/ck", max_rows=25, interval_seconds=0.2, duration_seconds=20, tie_break="id")
    sizes = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert max(sizes) < 60 and sum(sizes) == 100
    # rows that come later under the last key are found by their tie-break
    spark.range(100, 103).selectExpr("9L as k", "id").write.mode("append").parquet(src)
    poll_stream(spark, src, rows.schema, "k", tmp_dir + "/out", tmp_dir + "/ck", available_now=True, tie_break="id")
    assert sorted(r.id for r in spark.read.parquet(tmp_dir + "/out").collect()) == list(range(103))


def test_poll_stream_refuses_null_keys(spark, tmp_dir):
    spark.sql("select cast(null as bigint) k").write.parquet(tmp_dir + "/src")
    with pytest.raises(Exception, match="NULL"):
        poll_stream(spark, tmp_dir + "/src", spark.read.parquet(tmp_dir + "/src").schema, "k", tmp_dir + "/out", tmp_dir + "/ck", available_now=True)


def test_stream_dedup_and_fitted_statistics(spark, tmp_dir):
    from scour.operators import stats
    from scour.streaming import dedup_stream
    src = tmp_dir + "/ev"
    df = spark.range(200).selectExpr("id % 50 as k", "cast(id as double) v",
                                     "timestamp_seconds(1700000000 + id) as ts")
    df.repartition(4).write.parquet(src)
    stream = file_stream(spark, src, "parquet", df.schema)
    batch = spark.read.parquet(src)
    scale = stats.fit_standardize(batch, ["v"])
    bounds = stats.iqr_bounds(batch, ["v"])
    ingest(stream, tmp_dir + "/out", tmp_dir + "/ck", available_now=True,
           transform=lambda s: stats.apply_standardize(
               stats.within_bounds(dedup_stream(s, ["k"], "ts", "1 hour"), bounds), scale))
    out = spark.read.parquet(tmp_dir + "/out")
    assert out.count() == 50 and out.select("k").distinct().count() == 50
    m, sd = scale["v"]
    # one row per key survives (the first seen); its value is standardized
    for r in out.collect():
        original = r.v * sd + m
        assert abs(original - round(original)) < 1e-9 and round(original) % 50 == r.k
