"""Layout against a token-by-token round-robin, and the query against whole encodings."""

import heapq
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from scour.llm import packing

PATH = P.path("byte_bpe_50k.json")


def brute(lengths, weights, window):
    """(window, queue) of each token, served one by one in order of due time."""
    heap = [(0.5 / w, s, 0) for s, (n, w) in enumerate(zip(lengths, weights)) if n]
    heapq.heapify(heap)
    out, k = {}, 0
    while heap:
        _, s, j = heapq.heappop(heap)
        out[s, j] = k // window
        k += 1
        if j + 1 < lengths[s]:
            heapq.heappush(heap, ((j + 1.5) / weights[s], s, j + 1))
    return out


@pytest.mark.parametrize("lengths,weights,window", [
    ([100, 50, 7], None, 16), ([1, 1, 1, 300], None, 8), ([64, 64], [1, 3], 10), ([5], None, 2), ([40, 3, 90], [5, 2, 1], 7),
    ([11, 13, 17, 19, 23, 2, 1, 1, 1], None, 4)])
def test_schedule_is_the_token_by_token_one(lengths, weights, window):
    weights = weights or lengths
    sched = packing.Schedule(lengths, weights, window)
    n = -(-sum(lengths) // window)
    c = sched.served(np.arange(n + 1))
    want = brute(lengths, weights, window)
    for s, t in enumerate(lengths):
        got = [w for w in range(n) for _ in range(c[w + 1, s] - c[w, s])]
        assert got == [want[s, j] for j in range(t)]


def check(rows, texts, window):
    """texts: list of (doc_id, text), repeated ids allowed."""
    tok = Tokenizer.from_file(PATH)
    left = {}
    for d, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        left.setdefault((d, len(ids)), []).append(np.array(ids, "<u4"))
    total = sum(len(x) for v in left.values() for x in v)
    seqs, pieces = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sorted(seqs) == list(range(-(-total // window)))
    for s, v in seqs.items():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == window or s == max(seqs) and at <= window
    assert pieces.keys() == left.keys()
    for k, v in pieces.items():
        if len(left[k]) == 1:
            at = 0
            for r in sorted(v, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(left[k][0][at:at + r.length].tobytes())
                at += r.length
            assert at == k[1]
        assert sum(r.length for r in v) == k[1] * len(left[k])


def test_pack_edges(spark):
    texts = [(1, "one two three " * 400, "a"), (2, None, "a"), (3, "", None), (4, "x" * 9000, "b"), (4, "x" * 9000, "b"),
             (None, "no id here", "b"), (6, "tail", None), (7, "<|endoftext|>  two  spaces ", "c")]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, source string, length string")
    rows = packing.pack(df.repartition(3), PATH, window=256).collect()
    check(rows, [(d, t) for d, t, _ in texts], 256)
    skewed = packing.pack(df, PATH, {"a": 1, "b": 5, "c": 1, None: 1}, window=64).collect()
    check(skewed, [(d, t) for d, t, _ in texts], 64)
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_windows_hold_the_mixture(spark):
    from scour.llm import queries
    sf = "/root/testdata/sf0.001"
    rows = queries.op3_pack_mixture(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(rows, [(r.doc_id, r.text) for r in docs], 2048)
    total = {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + r.length
    n = sum(total.values())
    full = {}
    for r in rows:
        if r.sequence_id < n // 2048:
            full[r.sequence_id, r.source] = full.get((r.sequence_id, r.source), 0) + r.length
    for w in range(n // 2048):
        for s, t in total.items():
            assert abs(full.get((w, s), 0) - 2048 * t / n) <= 3
