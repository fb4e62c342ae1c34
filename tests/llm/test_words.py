"""Word hashes from bytes against plain splitting."""

import random

import numpy as np
import pyarrow as pa
import pytest

from scour.llm import words as W


def split(t):
    return (t or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_equal_words_have_equal_hashes(monkeypatch, chunk):
    monkeypatch.setattr(W, "CHUNK", chunk)
    rng = random.Random(chunk)
    alphabet = ["a", "b", "ab", "é", "日本", " ", "\x1c", "A", "Ab", " ", "  ", "\n", "\t\x0b", "\r", "\x0c"]
    texts = [None, "", " ", "x", *("".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(200)), "long" * 100, " a" * 50]
    seen = {}
    for fold in (False, True):
        column = pa.array([None, "skipped", *texts], pa.string()).slice(2)
        got = []
        for first, sizes, h in W.chunks(column, fold):
            assert first == len(got)
            ends = np.cumsum(sizes)
            got += [h[z - n:z].tolist() for n, z in zip(sizes.tolist(), ends.tolist())]
        assert len(got) == len(texts)
        for t, own in zip(texts, got):
            t = "".join(chr(ord(c) + 32) if fold and "A" <= c <= "Z" else c for c in t or "")
            words = [w for w in split(t) if w]
            assert len(words) == len(own)
            for w, h in zip(words, own):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_stretches_depend_on_their_items_alone():
    x = np.array([5, 7, 5, 7, 5, 7, 9], np.uint64)
    s = W.Stretches(x)
    a = s.at(np.arange(6), 2)
    assert a[0] == a[2] == a[4] and a[1] == a[3] and len(set(a.tolist())) == 3
    assert s.at(np.array([0]), 3) != s.at(np.array([0]), 2) and W.Stretches(x[4:]).at(np.array([0]), 3) == s.at(np.array([4]), 3)


def test_empty():
    assert list(W.chunks(pa.array([], pa.string()))) == [] and len(W.text_hashes(None)) == 0
