"""The metric join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scour.llm import jaccard as J
from scour.llm import queries
from scour.llm import words as W

SF = "/root/testdata/sf0.01"


def shingles(t, k=5):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = t.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    """rows: (id, text); sorted (id, n, component)."""
    sets = [shingles(t) for _, t in rows]
    index, root = {}, list(range(len(rows)))
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in index[g] if j < i}:
            if find(i) != find(j) and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return sorted(((d, len(s), first.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = queries.op13_jaccard_metric(spark, SF)
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    got, want = rows_of(df), brute(rows)
    assert got == want and len({c for _, _, c in want}) < len(want)


def family(rng, n, words, edits, vocabulary=400):
    base = [f"v{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            i = rng.randrange(len(own))
            own[i:i + rng.randint(0, 1)] = [f"e{rng.randrange(10 ** 6)}"] * rng.randint(0, 2)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_at_every_distance(spark, seed):
    rng = random.Random(seed)
    texts = []
    for words, edits in ((40, 3), (60, 6), (150, 12), (300, 14), (12, 1)):
        texts += family(rng, rng.randint(20, 70), words, edits)
    # chains: each a little further from the first
    chain = family(rng, 1, 120, 0)[0].split()
    for i in range(30):
        chain[rng.randrange(len(chain))] = f"c{i}"
        texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {' '.join(f'q{rng.randrange(10 ** 6)}' for _ in range(rng.randint(5, 40)))}" for _ in range(60)]
    texts += [None, "", " \n\t", "one two", "ONE  two", "one two three four five", "One Two three four five six", "é" * 20, "x " * 300, "x " * 299]
    texts += rng.choices(texts, k=40)
    rng.shuffle(texts)
    rows = [(rng.choice([None, i, i, i, i // 3]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("id", F.lit(1)).repartition(6)
    want = brute(rows)
    radii = [J.RADII, (0.0,), (0.1, 0.0)][seed]
    assert rows_of(J.near_duplicates(df, radii=radii)) == want
    assert len({c for _, _, c in want}) < len(want) - 50


def test_the_bound_is_met_exactly(spark):
    a = " ".join(f"w{i}" for i in range(13))  # nine shingles
    rows = [(1, a), (2, a + " x"), (3, a + " x y"), (4, a + " x y z"), (5, "w0 " + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(J.near_duplicates(df)) == brute(rows)
    tens = " ".join(f"t{i}" for i in range(12))  # eight of ten: linked at 0.8 exactly
    rows = [(1, tens), (2, tens + " u v"), (3, tens + " u v w")]
    assert rows_of(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows) == [(1, 8, 1), (2, 10, 1), (3, 11, 1)]


def test_empty(spark):
    df = spark.createDataFrame([(1, None), (None, " ")], "doc_id long, text string")
    assert rows_of(J.near_duplicates(df)) == [(1, 0, 1), (None, 0, None)]
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_sets_of_a_chunk_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 10)
    texts = ["a b c d e f", None, "a b", "a b c d e f g", "", "A B c D e F"]
    got = [s for _, sets in J.shingle_sets(pa.array(texts), 5) for s in sets]
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert np.array_equal(got[0], got[5]) and np.isin(got[0], got[3]).all()


def test_signatures_spare_pairs_that_lie_too_far_apart(spark, monkeypatch):
    # alike, but no two within the bound: sharing a token of the prefixes is no reason to compare two of them
    rng = random.Random(7)
    base = [f"b{i}" for i in range(140)]
    texts = []
    for _ in range(120):
        own = list(base)
        for i in rng.sample(range(140), 2):
            own[i] = f"e{rng.randrange(10 ** 9)}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    compared, real = [], J.Join.distances

    def distances(self, pairs, nodes):
        compared.append(pairs.count())
        return real(self, pairs, nodes)

    monkeypatch.setattr(J.Join, "distances", distances)
    got = rows_of(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radii=(0.0,)))
    sets = [shingles(t) for t in texts]
    alike = sum(5 * len(a & b) >= 3 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert got == brute(rows) and alike > 7000 and sum(compared) < 2500


def test_signatures_never_rule_out_a_pair_within_reach(spark):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        n = int(rng.integers(1, 400))
        s = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [s, np.concatenate([s[rng.random(n) < 0.85], rng.integers(0, 1 << 63, n // 9 + 1, dtype=np.uint64)])]
    n = np.array([len(s) for s in sets])
    sig = J.signatures(np.concatenate(sets), n)
    rows = [(int(n[i]), sig[i].tolist(), int(n[i + 1]), sig[i + 1].tolist(), 1 - len(set(sets[i]) & set(sets[i + 1])) / len(set(sets[i]) | set(sets[i + 1])))
            for i in range(0, len(sets), 2)]
    df = spark.createDataFrame(rows, "n int, s array<long>, m int, t array<long>, away double")
    assert df.where(~J.may_lie_within(F.col("away"), (F.col("n"), F.col("m")), (F.col("s"), F.col("t")))).count() == 0
