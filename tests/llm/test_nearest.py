"""Block search against a plain one; quantisation bounds hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scour.llm import nearest, queries


def brute(rows, k=5, asked=lambda i: i % 50 == 0):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v):
            ok.setdefault(i, []).append(np.array(v, np.float64))
    out = set()
    for q in ok:
        if asked(q):
            best = []
            for c, vs in ok.items():
                same = [(x, v) for x in ok[q] for v in vs if len(v) == len(x)]
                if c != q and same:
                    best.append((max((x * v).sum() / (np.sqrt((x ** 2).sum()) * np.sqrt((v ** 2).sum())) for x, v in same), c))
            best.sort(key=lambda x: (-x[0], x[1]))
            out |= {(q, r + 1, c, round(float(s), 12)) for r, (s, c) in enumerate(best[:k])}
    return out


def run(df, **options):
    got = nearest.search(df, F.col("vec_id") % 50 == 0, **options).collect()
    return [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in got]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in queries.op10_block_nearest(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_small_blocks_ties_and_edges(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(160)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, rows[3][1]), (203, [0.0] * 6), (204, None), (205, [None] + [1.0] * 5),
             (206, [float("nan")] + [1.0] * 5), (207, [float("inf")] + [1.0] * 5), (250, rows[3][1]), (None, rows[4][1]),
             (300, [1.0, 2.0]), (301, [2.0, 4.0]), (350, [1e30, -1e30]), (208, []), (50, rows[50][1]), (202, rows[3][1]),
             (100, rows[7][1]), (100, rows[8][1]), (9, rows[10][1])]  # several vectors to an id
    df = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding array<{kind}>, rank int")
    got = run(df, candidates=16, block=2)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert run(df.limit(0)) == []
    few = df.where("vec_id in (50, 51, 52)")
    assert set(run(few)) == brute([r for r in rows if r[0] in (50, 51, 52)])


@pytest.mark.parametrize("held", [1, 3000, 1 << 26])
def test_slots_of_any_size_give_the_same(spark, monkeypatch, held):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    monkeypatch.setattr(nearest, "HELD", held)
    assert set(run(df, candidates=16, block=3)) == brute(rows)


def test_blocks_are_numbered_without_gaps(spark):
    at = spark.range(0, 50, 1, 6).select(F.monotonically_increasing_id().alias("at"))
    path = nearest.materialize(at, "numbered")
    assert sorted(r.n for r in nearest.numbered(path).collect()) == list(range(50))


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for scale in (1e-30, 1.0, 1e200):
        a, b = rng.normal(size=(40, 33)) * scale, rng.normal(size=(70, 33)) * scale
        ac, s, l, e = nearest.quantise(a)
        bc, t, _, f = nearest.quantise(b)
        about = nearest.products(ac, bc) * s[:, None] * t
        exact = nearest.cosine(np.repeat(a, 70, 0), np.tile(b, (40, 1))).reshape(40, 70)
        assert (np.abs(about - exact) <= e[:, None] + l[:, None] * f + 1e-12).all()
