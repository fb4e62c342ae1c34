"""Product codes against plain Python integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scour.llm import codes, queries

SF = "/root/testdata/sf0.01"


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vec, label); the rows of the result, sorted."""
    kept = [(i, [math.floor(256 * x) for x in map(float, v)], g) for i, v, g in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    named = [(i, v) for i, v, _ in kept if i is not None]
    if not named:
        return []
    dim = len(min(named)[1])
    kept, firsts = [k for k in kept if len(k[1]) == dim], {}
    for i, v, _ in kept:
        if i is not None:
            firsts[i] = min(firsts.get(i, v), v)
    width = -(-dim // parts)
    cut = lambda v: [(v + [0] * (parts * width - dim))[p * width:(p + 1) * width] for p in range(parts)]
    first = [cut(firsts[i]) for i in sorted(firsts)][:entries]
    books = [[f[p] for f in first] for p in range(parts)]
    cuts = [cut(v) for _, v, _ in kept]

    def assign(c):
        out = []
        for p in range(parts):
            d = [sum((a - b) ** 2 for a, b in zip(c[p], e)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = [assign(c) for c in cuts]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, g in zip(cuts, got) if g[p][0] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    got = [assign(c) for c in cuts]
    errors = [sum(d for _, d in g) for g in got]
    sums = {}
    for (_, _, label), e in zip(kept, errors):
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k, _ in g), e, sums[label], sha)
                   for (i, _, label), g, e in zip(kept, got, errors)), key=str)


def rows_of(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_whole_table_and_sql(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    got = queries.op11_vector_codes(spark, SF)
    assert rows_of(got) == want and len(want) > 400
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(con.sql(queries.ORACLE["op11_vector_codes"]).fetchall(), key=str) == want


@pytest.mark.parametrize("kind,dim,scale", [("float", 32, 1.0), ("double", 16, 3.0), ("double", 40, 1e5), ("double", 7, 1e7), ("double", 16, 1e11)])
def test_any_size_of_number(spark, kind, dim, scale):
    rng = random.Random(dim)
    rows = [(i // 2 if i % 7 else i, [rng.gauss(0, scale) for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(3, None, 1), (4, [float("nan")] * dim, 1), (5, [None] + [1.0] * (dim - 1), 2), (6, [float("inf")] * dim, 2), (7, [], 3),
             (None, rows[0][1], 9), (None, rows[1][1], None), (8, [1.0] * (dim + 1), 1), rows[5], rows[5]]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("id", F.lit("x")).withColumn("code", F.lit(1))
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = rows_of(codes.encode(df.repartition(4)))
    want = [(i, c, e if e <= codes.LONG else None, s if scale < 1e10 else None, h) for i, c, e, s, h in brute(rows)]
    assert [g[:3] + (g[3] if scale < 1e10 else None, g[4]) for g in got] == want


def test_ties_go_to_the_lower_entry_and_unused_entries_stay(spark):
    v = [[0.0] * 16, [0.0] * 16, [2.0] * 16, [1.0] * 16]
    df = spark.createDataFrame([(i, x, "a") for i, x in enumerate(v)], "vec_id long, embedding array<float>, label string")
    got = rows_of(codes.encode(df))
    assert got == brute([(i, x, "a") for i, x in enumerate(v)])
    assert got[0][1] == got[1][1] == "00" * 16


def test_empty(spark):
    df = spark.createDataFrame([(1, None, 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert codes.encode(df).count() == 0 and codes.encode(df.limit(0)).count() == 0
    assert codes.encode(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("bits", [3, 20, 26, 29])
def test_limbs_multiply_exactly(bits):
    rng = np.random.default_rng(bits)
    x, c = (rng.integers(-(1 << bits), 1 << bits, (2, n, 5)) for n in (40, 9))
    want = np.einsum("prw,pew->pre", x.astype(object), c.astype(object))
    assert (codes.dots(x, c) == want).all()
