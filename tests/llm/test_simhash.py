"""Fingerprints, pigeonring buckets and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scour.llm import queries, simhash
from scour.llm.components import components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids_fps, max_bits=4):
    fps = np.array([f for _, f in ids_fps], np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= max_bits) + i + 1:
            root[find(int(j))] = find(i)
    low = {}
    for i, (d, _) in enumerate(ids_fps):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(fps))]


def test_fingerprint_matches_spark_hash(spark):
    assert spark.sql("select xxhash64('a b c d') h").first().h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)
    for t in (None, "", " \n", "One", "A B c", "ÉÀ İ a b C d e", "x " * 100_000, "a\x0bb\x0cc\x1cd e f g"):
        assert simhash.fingerprint(t) == brute_fp(t)


@pytest.mark.parametrize("bits,segments", [(4, 6), (0, 2), (3, 5), (4, 5), (4, 8), (2, 4), (1, 3)])
def test_every_near_pair_shares_a_bucket_and_survives(bits, segments):
    ring = simhash.Ring(bits, segments)
    rng = random.Random(5)
    tables = ring.tables()
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), rng.randint(0, bits + 1)):
            b ^= 1 << i
        found = any((a ^ b) & (ring.mask[i] | ring.mask[j]) == 0
                    and len(ring.near(np.array([a ^ b], np.uint64), i)) for i, j in tables)
        assert found == ((a ^ b).bit_count() <= bits)


def table(spark, pairs):
    return spark.createDataFrame([(d, int(np.uint64(f).astype(np.int64))) for d, f in pairs], "doc_id long, fp long")


@pytest.mark.parametrize("tile", [4096, 7])
def test_links_connect_what_is_near(spark, tile):
    rng = random.Random(tile)
    pairs = []
    for c in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            f = base
            for i in rng.sample(range(64), rng.randint(0, 6)):
                f ^= 1 << i
            pairs.append((len(pairs), f))
    nodes = table(spark, pairs).groupBy("fp").agg(F.min("doc_id").alias("id"))
    got = {r.node: r.root for r in components(simhash.links(nodes, simhash.Ring(), tile)).collect()}
    want = brute_components(pairs)
    mine = {}
    for (d, f), w in zip(pairs, want):
        s = int(np.uint64(f).astype(np.int64))
        mine.setdefault(got.get(s, s), set()).add(w)
    assert all(len(v) == 1 for v in mine.values()) and len(mine) == len(set(want))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (900, 901), (901, 900)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}
    assert components(links.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, brute_fp(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(docs, brute_components(docs))}
    rows = queries.op6_simhash_pigeonring(spark, sf).collect()
    assert len(rows) == len(docs) and {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want


def test_edges_and_keep_one(spark):
    rows = [(5, None, "a"), (3, "", "b"), (9, "same words in here twice", "a"), (9, "same words in here twice", "a"),
            (None, "same words in here twice", "c"), (None, "alone without any id at all", "c"), (1, "one other text " * 5000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 9), (None, 9), (None, None), (1, 1)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(kept.collect(), key=str) == sorted([rows[1], rows[2], rows[5], rows[6]], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0
