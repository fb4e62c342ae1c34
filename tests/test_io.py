import os

import pytest

from scour import sinks, sources
from scour.operators import cleaning, verify
from scour.sinks.jdbc import clickhouse_ddl, clickhouse_frame, resolve_target, write_steps


def test_csv_cleaning_chain(spark, tmp_dir):
    df = spark.createDataFrame([("n1", 7), ("n2", None), ("n1", 7), ("n3", 0)], "node string, load int")
    sinks.write_file(df, "csv", tmp_dir + "/raw", "overwrite")
    clean = cleaning.fill_na(cleaning.dedup(sources.read_csv(spark, tmp_dir + "/raw")), -1)
    sinks.write_file(clean, "csv", tmp_dir + "/clean", "overwrite")
    assert {r.node: r.load for r in sources.read_csv(spark, tmp_dir + "/clean").collect()} == {"n1": 7, "n2": -1, "n3": 0}


def test_csv_keeps_what_a_value_holds(spark, tmp_dir):
    odd = ['a "quoted" word', "two\nlines", "cr\r\nlf", 'ends with "', "comma, and; semi", " blanks around ", "back\\slash", '\\"', "", None, "'", "#x"]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string")
    sinks.export_table(df, tmp_dir + "/e", "csv")
    back = sources.read_csv(spark, tmp_dir + "/e", schema=df.schema)
    # CSV has one way to write NULL and the empty string
    assert {r.i: r.t for r in back.collect()} == {i: t or None for i, t in enumerate(odd)}


def test_copy_to_csv_verifies(spark, tmp_dir):
    df = spark.createDataFrame([("0123", 1.0, 'x "y"\nz'), ("", None, None), ("007", 2.5, " ")], "code string, v double, t string")
    df.write.parquet(tmp_dir + "/src")
    for fmt in ("csv", "json", "parquet"):
        rows, ver = verify.copy_table(spark, {"type": "parquet", "path": tmp_dir + "/src"},
                                      {"type": fmt, "path": f"{tmp_dir}/{fmt}", "mode": "overwrite"})
        assert rows == 3 and verify.status(ver) == "success", fmt
    a, b = spark.createDataFrame([(1, "2")], "n int, s string"), spark.createDataFrame([(1.0, 2)], "n double, s int")
    assert verify.status(verify.verification(a, b)) == "success"


def test_csv_with_bom_and_non_ascii_header(spark, tmp_dir):
    path = os.path.join(tmp_dir, "people.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("姓名,年龄,城市\n张三,25,北京\n李四,30,上海\n")
    df = sources.read_csv(spark, path)
    assert df.columns == ["姓名", "年龄", "城市"]
    assert dict(df.dtypes)["年龄"] == "int"
    assert sources.read_csv(spark, path, infer_schema=False).dtypes[1][1] == "string"


def test_parquet_json_round_trips_and_modes(spark, tmp_dir):
    df = spark.range(5).selectExpr("id", "cast(id as string) s")
    for fmt in ("parquet", "json"):
        p = f"{tmp_dir}/{fmt}"
        sinks.write_file(df, fmt, p, "overwrite")
        sinks.write_file(df, fmt, p, "append")
        assert sources.read_file(spark, fmt, p).count() == 10
    with pytest.raises(ValueError):
        sinks.write_file(df, "parquet", tmp_dir + "/x", "upsert")
    sinks.export_table(df, tmp_dir + "/exp", "json")
    assert sources.read_json(spark, tmp_dir + "/exp").count() == 5


def test_read_source_query_and_errors(spark, tmp_dir):
    spark.range(10).write.parquet(tmp_dir + "/t")
    df = sources.read_source(spark, {"type": "parquet", "path": tmp_dir + "/t",
                                     "query": "SELECT id FROM source WHERE id > 6"})
    assert df.count() == 3
    with pytest.raises(ValueError, match="type"):
        sources.read_source(spark, {"path": tmp_dir + "/t"})
    with pytest.raises(ValueError, match="unsupported"):
        sources.read_source(spark, {"type": "excel", "path": "x"})


def test_listing_scan_copy_and_digests(spark, tmp_dir):
    root = os.path.join(tmp_dir, "bucket")
    os.makedirs(os.path.join(root, "sub"))
    for name, body in (("a.csv", b"1,2\n"), ("sub/b.json", b"{}\n"), ("c.bin", b"\x00" * 10)):
        with open(os.path.join(root, name), "wb") as f:
            f.write(body)
    listing = sources.list_objects(spark, root)
    assert sorted(r.Key for r in listing.collect()) == ["a.csv", "c.bin", "sub/b.json"]
    scan = {r.name: r.size_bytes for r in sources.scan_data_dir(spark, root).collect()}
    assert scan == {"a.csv": 4, "b.json": 3}
    copied = sinks.copy_objects(listing, os.path.join(tmp_dir, "copy"))
    assert copied.where("error is null").count() == 3
    res = sinks.verify_copy(listing, os.path.join(tmp_dir, "copy"))
    assert all(r.ok for r in res.collect()) and res.count() == 3
    assert open(os.path.join(tmp_dir, "copy", "sub", "b.json"), "rb").read() == b"{}\n"


def fill(root, names):
    for i, name in enumerate(names):
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(b"" if "empty" in name else name.encode() * (i + 1))


def test_listing_is_complete_and_copies_verify_what_is_there(spark, tmp_dir, monkeypatch):
    names = ["_hidden", ".dot", "empty", "a/_b/c.bin", "a/d/e/f/g.txt", "a/d/e/empty.csv", "z.csv"]
    fill(tmp_dir + "/bucket", names)
    monkeypatch.chdir(tmp_dir)
    spark_dir = os.getcwd()
    for root in (tmp_dir + "/bucket", "file://" + tmp_dir + "/bucket", tmp_dir + "/bucket/"):
        assert sorted(r.Key for r in sources.list_objects(spark, root).collect()) == sorted(names), (root, spark_dir)
    listing = sources.list_objects(spark, tmp_dir + "/bucket")
    assert [r.Key for r in sources.list_objects(spark, tmp_dir + "/bucket", pattern="*.csv", recursive=False).collect()] == ["z.csv"]
    done = sinks.copy_objects(listing, tmp_dir + "/target")
    assert done.count() == len(names) and done.where("error is not null").count() == 0
    with open(tmp_dir + "/target/z.csv", "wb") as f:
        f.write(b"junk")
    os.remove(tmp_dir + "/target/a/_b/c.bin")
    bad = {r.Key: r.reason for r in sinks.verify_copy(listing, tmp_dir + "/target").where("not ok").collect()}
    assert bad == {"z.csv": "digest_mismatch", "a/_b/c.bin": "missing_in_target"}
    assert done.count() == len(names)       # using the result copies nothing again
    assert open(tmp_dir + "/target/z.csv", "rb").read() == b"junk"


def test_objects_that_cannot_be_copied_are_reported(spark, tmp_dir):
    fill(tmp_dir + "/b", ["one", "two"])
    listing = sources.list_objects(spark, tmp_dir + "/b").cache()
    listing.count()
    os.remove(tmp_dir + "/b/two")
    out = {r.Key: r.error for r in sinks.copy_objects(listing, tmp_dir + "/t").collect()}
    assert out["one"] is None and "FileNotFoundError" in out["two"]


def test_copies_on_a_cluster_go_to_shared_folders_only(spark, tmp_dir, monkeypatch):
    import sys
    from scour.session import scratch_path
    fill(tmp_dir + "/b", ["one", "two"])
    listing = sources.list_objects(spark, tmp_dir + "/b")
    monkeypatch.setattr(sys.modules["scour.sinks.objects"], "is_local", lambda master: False)
    target = scratch_path(spark, "copy")        # below spark.checkpoint.dir
    assert sinks.copy_objects(listing, target).where("error is null").count() == 2
    assert all(r.ok for r in sinks.verify_copy(listing, target).collect())
    with pytest.raises(ValueError, match="another folder"):
        sinks.copy_objects(listing, tmp_dir + "/elsewhere")


def test_jdbc_options_and_targets():
    url = sources.jdbc_url("mysql", "h", None, "db")
    assert url == "jdbc:mysql://h:3306/db"
    assert sources.jdbc_url("clickhouse", "h", 8123) == "jdbc:clickhouse://h:8123/default"
    opts = sources.jdbc_options(url, table="t", user="u", partition_column="id",
                                lower_bound=1, upper_bound=100, num_partitions=8)
    assert opts["dbtable"] == "t" and opts["numPartitions"] == "8" and opts["fetchsize"] == "5000"
    assert opts["driver"] == "com.mysql.cj.jdbc.Driver"
    with pytest.raises(ValueError):
        sources.jdbc_options(url, table="t", query="select 1")
    q = sources.jdbc_options(url, query="SELECT * FROM t WHERE x > 1")
    assert q["query"].startswith("SELECT")
    kind, turl, topts = resolve_target({"type": "system_clickhouse", "table": "t"},
                                       {"system_clickhouse": {"host": "ck", "port": 8123, "user": "d"}})
    assert (kind, turl, topts) == ("clickhouse", "jdbc:clickhouse://ck:8123/default", {"user": "d"})
    with pytest.raises(ValueError):
        resolve_target({"type": "jdbc", "table": "t"})


def test_clickhouse_ddl(spark):
    from pyspark.sql.types import StructType
    df = spark.createDataFrame([(1, 2.0, "x", True)], "a int, b float, `c d` string, e boolean")
    ddl = clickhouse_ddl(df.schema)
    assert ddl == "`a` bigint, `b` double, `c d` string, `e` string"
    assert StructType.fromDDL(ddl).simpleString() == clickhouse_frame(df).schema.simpleString()


def test_create_like_source_never_turns_an_overwrite_into_an_append():
    assert write_steps("overwrite", False, False) == [(True, "overwrite", False)]
    assert write_steps("overwrite", True, False) == [(True, "overwrite", True)]
    assert write_steps("overwrite", False, True) == [(False, "ignore", False), (True, "overwrite", True)]
    assert write_steps("append", False, True) == [(False, "ignore", False), (True, "append", False)]
    assert write_steps("error", False, True) == [(True, "error", False)]


def test_json_array_export(spark, tmp_dir):
    import json
    import os
    from scour.sinks import export_table
    df = spark.createDataFrame([(1, None), (2, 'a "b"\n,'), (3, "é")], "k int, s string")
    want = [{"k": 1, "s": None}, {"k": 2, "s": 'a "b"\n,'}, {"k": 3, "s": "é"}]

    def arrays(path):
        texts = [open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.startswith("part-")]
        return [json.loads(t) for t in texts if t]

    export_table(df.repartition(5, "k"), tmp_dir + "/many", "json", lines=False)
    assert sorted((r for x in arrays(tmp_dir + "/many") for r in x), key=lambda r: r["k"]) == want
    export_table(df, tmp_dir + "/one", "json", lines=False, single=True)
    assert len(arrays(tmp_dir + "/one")) == 1 and sorted(arrays(tmp_dir + "/one")[0], key=lambda r: r["k"]) == want
    export_table(df.limit(0), tmp_dir + "/none", "json", lines=False, single=True)
    assert arrays(tmp_dir + "/none") in ([], [[]])


ODD_CSV = [(1, "plain", "x"), (2, 'line\nbreak, "quoted"', None), (3, "\r\n", "é\n\n"), (4, ",,,", '"'), (5, "tail " * 50, "last\n"), (6, None, None), (7, " a ", "b")]


@pytest.mark.parametrize("split", [7, 64, 1000])
def test_csv_with_line_breaks_in_splits(spark, tmp_dir, split):
    from scour.sinks import export_table
    from scour.sources.files import read_csv
    df = spark.createDataFrame([(i * 10 + k, a, b) for i in range(20) for k, a, b in ODD_CSV], "k int, a string, b string")
    export_table(df.repartition(2), tmp_dir + "/csv", "csv")
    whole = sorted(map(tuple, read_csv(spark, tmp_dir + "/csv", schema=df.schema).collect()), key=str)
    got = read_csv(spark, tmp_dir + "/csv", schema=df.schema, split_bytes=split)
    assert sorted(map(tuple, got.collect()), key=str) == whole and got.rdd.getNumPartitions() > 4
    text = read_csv(spark, tmp_dir + "/csv", infer_schema=False, split_bytes=split)
    assert text.columns == ["k", "a", "b"] and sorted(r.k for r in text.collect()) == sorted(str(r[0]) for r in whole)


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 20])
def test_csv_ranges_are_read_in_blocks(tmp_dir, monkeypatch, block):
    import csv
    import io
    from scour.sources import csvsplit
    text = io.StringIO()
    csv.writer(text, lineterminator="\r\n").writerows([("k", "a", "b")] + [(i, a, b) for i in range(5) for _, a, b in ODD_CSV])
    for body in (text.getvalue(), "\ufeff" + text.getvalue().removesuffix("\r\n"), '"k",x"y"\n\n1,"2""3"\n'):
        with open(tmp_dir + "/x.csv", "wb") as f:
            f.write(body.encode())
        data, most = body.encode(), [0]

        class Watched(io.BytesIO):
            def read(self, n):
                most[0] = max(most[0], n)
                return super().read(n)

        f, size = Watched(data), len(data)
        monkeypatch.setattr(csvsplit, "BLOCK_BYTES", 1 << 30)
        want = [r for part in csvsplit._cut(f, 0, size, size, 0, True) for r in part]
        whole = csvsplit._count(f, 0, size, 44)
        monkeypatch.setattr(csvsplit, "BLOCK_BYTES", block)
        most[0] = 0
        assert csvsplit._count(f, 0, size, 44) == whole
        for step in (7, 50, 1000):
            got, odd, quotes = [], 0, 0
            for lo in range(0, size, step):
                hi = min(lo + step, size)
                n, *odds = csvsplit._count(f, lo, hi, 44)
                got += [r for part in csvsplit._cut(f, lo, hi, size, quotes % 2, True) for r in part]
                odd, quotes = odd + odds[quotes % 2], quotes + n
            assert got == want and (quotes, odd) == whole[:2]
        assert most[0] <= max(block, 1)


def test_csv_splits_leave_odd_quotes_to_the_whole_reader(spark, tmp_dir):
    from scour.sources.files import read_csv
    path = tmp_dir + "/odd.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write("\ufeffk,a\r\n" + "".join(f'{i},5" disk {i}\r\n' for i in range(100)))
    got = read_csv(spark, path, schema="k int, a string", split_bytes=50)
    assert sorted((r.k, r.a) for r in got.collect()) == [(i, f'5" disk {i}') for i in range(100)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\ufeff\"k\",a\r\n" + "".join(f'{i},"x\n{i}"\r\n' for i in range(100)) + '100,"no end of line"')
    got = read_csv(spark, path, schema="k int, a string", split_bytes=50)
    assert sorted((r.k, r.a) for r in got.collect()) == [*((i, f"x\n{i}") for i in range(100)), (100, "no end of line")]
    assert got.rdd.getNumPartitions() > 4


def test_documents_as_one_csv_file_in_many_tasks(spark, tmp_dir):
    from scour.sinks import export_table
    from scour.sources.files import read_csv
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    export_table(docs, tmp_dir + "/docs", "csv", single=True)
    got = read_csv(spark, tmp_dir + "/docs", schema=docs.schema, split_bytes=200_000)
    assert got.rdd.getNumPartitions() >= 8
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, r.text or None, r.lang, r.source, r.n_chars) for r in docs.collect())
