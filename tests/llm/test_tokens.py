"""Piece-wise encodings against whole ones."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scour.llm import queries, tokens

ODD = ["", "a", "  a", " a", "a ", "a  b", "x <|endoftext|> y<|endoftext|>", "ab<|endoftext|>", "è́ a b",
       "a\n\n b", "a \n b", "foo\tbar baz", "it's we'll 'tis", "ΑΣ ΑΣ. Σ", "A\xa0B c",
       "x" * 3000 + " " + "y" * 10 + "  z", "<|startoftext|> q", "a\x1c b c\x85 d", "\U0001f642 \U0001f642\U0001f642 x"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é'\n\t .1²́日<|>\U0001f642Σ") for _ in range(rng.randint(0, 30)))
                   for _ in range(2000)]
    tok = Tokenizer.from_file(P.path(name))
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert tokens.count_batch(P.path(name), pa.array(texts)).tolist() == [len(w) for w in want]
    ids, width = tokens.ids_batch(P.path(name), pa.array(texts))
    assert [np.frombuffer(x, f"<u{width}").tolist() for x in ids] == want


def test_store_stays_bounded_and_chunks_are_balanced(monkeypatch):
    enc = tokens.Encoder(P.path("word_bpe_49k.json"), max_pieces=100)
    seen = {}
    for k in range(20):
        tokens.pieces(enc, seen, pa.array([" ".join(f"w{k}x{i}" for i in range(50))]), tokens._lengths)
        assert len(seen) <= 150
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 10)
    parts = list(tokens.chunks(pa.array(["aaaa", None, "", "bbbbbb", "c", "d" * 30, "e"])))
    assert [p.to_pylist() for p in parts] == [["aaaa", None, "", "bbbbbb"], ["c"], ["d" * 30], ["e"]]
    assert tokens.count_batch(P.path("word_bpe_49k.json"), pa.array([], pa.string())).tolist() == []


def test_counts_of_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(tok.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (None, "", "k"), (2, "a " * 3000, "k")],
                               "doc_id long, text string, n_tokens string")
    rows = sorted(map(tuple, tokens.token_counts(df, P.path("word_bpe_49k.json")).collect()), key=str)
    assert rows == [(1, 0, 0, False), (1, 0, 0, False), (2, 6000, 3000, True), (None, 0, 0, False)]
    assert tokens.token_counts(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_one_odd_blank_does_not_keep_a_text_together(name, monkeypatch):
    rng = random.Random(2)
    words = ["ab", "é", "<|endoftext|>", "x1", "\U0001f642", "it's", ".", "日本"]
    texts = []
    for _ in range(300):
        t = " ".join(rng.choices(words, k=rng.randint(1, 40)))
        for odd in rng.choices(["  ", " \t", "\n ", "\xa0 ", "   ", " \u3000"], k=rng.randint(1, 2)):
            i = rng.randint(0, len(t))
            t = t[:i] + odd + t[i:]
        texts.append(t)
    texts += ["\ue000 a  b", "plain words here", " ", "  "]
    tok = Tokenizer.from_file(P.path(name))
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    ids, width = tokens.ids_batch(P.path(name), pa.array(texts))
    assert [np.frombuffer(x, f"<u{width}").tolist() for x in ids] == want
    # a long text is never one call of the tokenizer
    longest = []
    whole, runs = tokens.Encoder.whole, tokens.Encoder.pieces
    monkeypatch.setattr(tokens.Encoder, "whole", lambda self, t: longest.extend(map(len, t)) or whole(self, t))
    monkeypatch.setattr(tokens.Encoder, "pieces", lambda self, u: longest.extend(map(len, u)) or runs(self, u))
    text = "word other  " + "some more words of it " * 2_400_000 + "end "
    n = tokens.count_batch(P.path(name), pa.array([text], pa.large_string()))[0]
    assert n >= 12_000_000 and max(longest) < 100
