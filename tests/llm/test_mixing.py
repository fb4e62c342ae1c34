"""The mix against a plain sort, and its targets against repeated resharing."""

import hashlib
import math
import random
import re

import pytest

from scour.llm import mixing


def targets(sizes):
    """Reshare the excess of the capped sources until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 3 * sizes[s]}
        if not full:
            return {**out, **{s: level * w[s] for s in open_}}
        for s in full:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def brute(rows):
    """rows: (doc_id, text, source); (doc_id, size, source_size, target, taken) of each distinct row."""
    def size(t):
        return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    aim, out = targets(sizes), []
    for s in sizes:
        def key(r):
            u = (int(hashlib.md5(f"0:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            noise = sum(c in mixing.NOISE for c in r[1] or "")
            return -math.log(u) * (1 + noise / max(size(r[1]), 1))
        epochs = aim[s] // sizes[s] if sizes[s] else 0
        left = math.floor(aim[s] - epochs * sizes[s] + 0.5)
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: (key(r), r[0] is not None, r[0] or 0)):
            n = size(r[1])
            part = min(n, left)
            left -= part
            out.append((r[0], n, sizes[s], aim[s], epochs * n + part))
    return out


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert (*g[:3], g[4]) == (*w[:3], w[4]) and math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-9)


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in d.collect()]
    got = [tuple(r)[:5] for r in mixing.mix(d).collect()]
    close(got, brute(rows))
    assert sorted(got) == sorted(tuple(r)[:5] for r in mixing.mix(d.repartition(7)).collect())


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 500, "d": 3}, {"a": 0, "b": 4, None: 9}, {"z": 7}])
def test_targets_and_budgets(spark, sizes):
    rows = []
    for s, n in sizes.items():
        at = 0
        while at < n:
            k = min(n - at, 1 + len(rows) % 17)
            rows.append((len(rows), "w " * k, s))
            at += k
        rows.append((len(rows), None, s))
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, source string, target double")
    got = [tuple(r)[:5] for r in mixing.mix(df).collect()]
    close(got, brute(rows))
    for s in sizes:
        own = [g for g, r in zip(sorted(got), sorted(rows, key=lambda r: r[0])) if r[2] == s]
        assert abs(sum(g[4] for g in own) - own[0][3]) <= 0.51 and all(g[4] <= 3 * g[1] for g in own)


@pytest.mark.parametrize("bins,edge", [(2, 1), (8, 5), (3, 40)])
def test_the_last_bin_is_cut_until_it_is_small(spark, monkeypatch, bins, edge):
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "EDGE", edge)
    rng = random.Random(bins)
    rows = [(i // 2, "w " * rng.randint(0, 9) + "#" * rng.choice([0, 0, 40]), rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    rows += [(7, "same row", "c")] * 50 + [(500, "few words", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r)[:5] for r in mixing.mix(df).collect()]
    monkeypatch.undo()
    assert sorted(got, key=str) == sorted((tuple(r)[:5] for r in mixing.mix(df).collect()), key=str)


def test_clashing_names(spark):
    names = ["__size", "__key", "__bin", "__id", "__row", "__n", "copies", "part", "size", "target", "source_size", "a.b"]
    df = spark.createDataFrame([(i, "some words", "a", *range(len(names))) for i in range(20)], ["doc_id", "text", "source", *names])
    out = mixing.resample(df)
    assert out.columns == df.columns and out.count() > 0
    assert all(tuple(r)[3:] == tuple(range(len(names))) for r in out.collect())


def test_edges_and_resample(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "q r s", "x"), (3, "e f " * 2000, None), (4, "", "y"), (5, None, "y")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, copies int")
    got = mixing.mix(df).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r.size for r in got)
    out = mixing.resample(df)
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[r.source, r.doc_id] = n.get((r.source, r.doc_id), 0) + 1
    assert n[None, 3] in (0, 1, 2) and n["x", 1] % 2 == 0
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.resample(df.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(df.where("doc_id > 3")).collect())


def test_better_documents_come_first(spark):
    rows = [(i, "plain words only here", "a") for i in range(400)] + [(i, "## ## ## ##", "a") for i in range(400, 800)] \
        + [(i, "x " * 4, "b") for i in range(800, 2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1, 11)).where("source_size = 3200").collect()
    clean = sum(r.taken for r in got if r.doc_id < 400)
    assert clean > 0.6 * sum(r.taken for r in got)
