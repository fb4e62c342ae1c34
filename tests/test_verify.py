from pyspark.sql import functions as F

from scour.operators import verify


def checks(df):
    return {r.check_name: (r.source, r.target, r.ok) for r in df.collect()}


def test_verification_detects_changes(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    same = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    other = spark.createDataFrame([(1, "a"), (2, "c")], "k int, v string")
    assert all(ok for _, _, ok in checks(verify.verification(src, same)).values())
    c = checks(verify.verification(src, other))
    assert c["row_count"][2] is True and c["checksum"][2] is False
    assert verify.status(verify.verification(src, other)) == "failed"
    msgs = verify.failure_messages(verify.verification(src, other)).collect()
    assert msgs[0].details.startswith("checksum differs: ")


def test_null_safe_checksum(spark):
    a = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    b = spark.createDataFrame([("a", "b", None)], "x string, y string, z string")
    compat = checks(verify.verification(a, b, null_safe=False))
    assert compat["checksum"][2] is True          # CONCAT_WS skips NULLs: collision
    assert checks(verify.verification(a, b))["checksum"][2] is False
    assert checks(verify.verification(a, b, algorithm="xxhash64"))["checksum"][2] is False


def test_row_diff_is_multiset(spark):
    src = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    tgt = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    out = sorted((r.side, r.k) for r in verify.row_diff(src, tgt).collect())
    assert out == [("source_only", 1), ("source_only", 2), ("target_only", 3)]


def test_verify_append(spark):
    src, tgt = spark.range(3), spark.range(8)
    r = verify.verify_append(5, src, tgt).first()
    assert r.ok and r.source == 8
    assert not verify.verify_append(4, src, tgt).first().ok


def test_compare_listings(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "Key string, ETag string")
    t = spark.createDataFrame([("a", "1"), ("b", "X"), ("d", "4")], "Key string, ETag string")
    out = {r.Key: (r.ok, r.reason) for r in verify.compare_listings(s, t).collect()}
    assert out == {"a": (True, None), "b": (False, "digest_mismatch"),
                   "c": (False, "missing_in_target"), "d": (False, "missing_in_source")}


def test_copy_table_overwrite_verifies(spark, tmp_dir):
    src_path = tmp_dir + "/src"
    spark.range(50).withColumn("v", F.col("id") * 2).write.parquet(src_path)
    rows, ver = verify.copy_table(spark, {"type": "parquet", "path": src_path},
                                  {"type": "parquet", "path": tmp_dir + "/dst", "mode": "overwrite"})
    assert rows == 50 and verify.status(ver) == "success"
    rows, ver = verify.copy_table(spark, {"type": "parquet", "path": src_path},
                                  {"type": "parquet", "path": tmp_dir + "/dst", "mode": "append"})
    assert rows == 50 and ver is None


def rows_of(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()))


def test_row_diff_by_buckets_is_the_row_diff(spark):
    import random
    rng = random.Random(1)
    rows = [(rng.choice([None, i, i % 7]), rng.choice([None, 0.0, -0.0, float("nan"), 1.5]), rng.choice(["a", "", None])) for i in range(400)]
    a = spark.createDataFrame(rows, "k long, x double, s string")
    changed = [(r[0], 0.0 if r[1] == 0 else r[1], r[2]) for r in rows[5:]] + [(9, 9.0, "new")] * 2 + rows[10:12]
    b = spark.createDataFrame(changed, "k long, x double, s string").repartition(3)
    want = rows_of(verify.row_diff(a, b, buckets=0))
    assert want and rows_of(verify.row_diff(a, b)) == want == rows_of(verify.row_diff(a, b, buckets=4))
    assert rows_of(verify.row_diff(a, a.repartition(5))) == []
    other = b.withColumn("k", F.col("k").cast("int"))
    assert rows_of(verify.row_diff(a, other)) == want
    assert verify.differing_buckets(a, a.limit(0), a.columns, 8) and not verify.differing_buckets(a.limit(0), a.limit(0), a.columns)


def test_only_differing_buckets_are_shuffled(spark, tmp_dir):
    spark.range(20_000).selectExpr("id", "id % 10 as g").write.parquet(tmp_dir + "/a")
    a = spark.read.parquet(tmp_dir + "/a")
    b = a.withColumn("g", F.when(F.col("id") == 77, 99).otherwise(F.col("g")))
    found = verify.differing_buckets(a, b, a.columns)
    assert len(found) == 2
    diff = verify.row_diff(a, b)
    assert rows_of(diff) == [("'source_only'", "77", "7"), ("'target_only'", "77", "99")]
    here = F.pmod(F.xxhash64("id", "g"), F.lit(verify.BUCKETS)).cast("int").isin(found)
    assert a.where(here).count() < 10           # of 20 000 rows
    plan = diff._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Union"):]
    assert below.count("Filter") == 2 and "xxhash64" in below
