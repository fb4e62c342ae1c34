"""Base spans against the contract's own patterns; disguises; offsets."""

import hashlib
import random
import re

import pytest

from scour.llm import pii, queries

BASE = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = []
    for k, r in enumerate(BASE):
        for m in r.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 3 and not 10 <= len(digits) <= 15
                    or k == 2 and not (14 <= len(digits) <= 19 and luhn(digits))):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    bits = ["a", ".", "@", "1", "23", "4", "5", " ", "-", "+", "(", ")", "b.c", "4111111111111111", "192.168.", "é", "\n"]
    for _ in range(20000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert pii.detect(t) == brute(t), t


@pytest.mark.parametrize("text,kind,span", [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("john at example dot com", "email", "john at example dot com"),
    ("j(at)ex.co.uk", "email", "j(at)ex.co.uk"),
    ("juan arroba ejemplo punto com", "email", "juan arroba ejemplo punto com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("a jоhn@mail.exam​ple.com", "email", "jоhn@mail.exam​ple.com"),
    ("ｊ＠ｅ．ｃｏｍ", "email", "ｊ＠ｅ．ｃｏｍ"),
    ("plus one five five five one two three four five six seven", "phone",
     "plus one five five five one two three four five six seven"),
    ("no four" + " one" * 15 + " end", "card", "four" + " one" * 15),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("ip 192 dot 168 dot 1 dot 20", "ip", "192 dot 168 dot 1 dot 20"),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("call +49 one70 five 2 three 4 six 789", "phone", "+49 one70 five 2 three 4 six 789"),
    ("card 4five39 1488 0343 6467", "card", "4five39 1488 0343 6467"),
    ("call +49.one.seven zero five 23 46 789 now", "phone", "+49.one.seven zero five 23 46 789"),
    ("card four  five\nthree-nine 1488 0343 6467", "card", "four  five\nthree-nine 1488 0343 6467"),
    ("write to bob at host.3x.com today", "email", "bob at host.3x.com"),
    ("bob at example.4chan.org or", "email", "bob at example.4chan.org"),
    ("plus SİX " + "one " * 10 + "x", "phone", "plus SİX " + ("one " * 10).strip()),
])
def test_disguises_map_back_to_the_source(text, kind, span):
    found = pii.disguised(text, pii.detect(text))
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in found] == [(kind, span)]


@pytest.mark.parametrize("text", ["plain at the end. Dot it", "a at b. c d", "see at ten.Five", "one two three", "un deux",
                                  "x @ y", "[at] [dot]", "﻿", "​" * 5, "at dot com"])
def test_clean_texts_stay_clean(text):
    assert pii.disguised(text, pii.detect(text)) == []


BITS = ["a", "bob", "x1", "3x.com", "host", ".", "com", " at ", " AT ", " dot ", " punkt ", "@", " @ ", "[", "(at)", "] ", "[dot]", "one", "Five", "sİx", "fünf",
        "zéro", "7", "42", "+49", "plus ", "MÁS 3", " ", "  ", "\n", "-", ", ", "_", "—", "“", "²", "é", "١", "о", "​", "1488 0343", "ſix", " arroba ", "co.uk"]


@pytest.mark.parametrize("seed", range(4))
def test_clues_hide_nothing(seed):
    """A transducer that its clue holds back would have done nothing."""
    rng, found = random.Random(seed), 0
    for _ in range(15_000):
        t = "".join(rng.choices(BITS, k=rng.randint(1, 14)))
        base = pii.detect(t)
        got = pii.disguised(t, base)
        assert got == pii.disguised(t, base, guarded=False), t
        found += bool(got)
    assert found > 300


def test_added_spans_hold_an_identifier_and_base_spans_stay():
    """Whatever is added reads, once rewritten, as an identifier of its kind, and touches no base span of its kind from inside."""
    rng = random.Random(9)
    for _ in range(5_000):
        t = "".join(rng.choices(BITS, k=rng.randint(1, 14)))
        base = pii.detect(t)
        for a, k, b in pii.disguised(t, base):
            assert 0 <= a < b <= len(t)
            assert not any(x <= a and b <= y for x, kind, y in base if kind == k)
            assert any(kind == k for _, kind, _ in pii.disguised(t[a:b], []) + pii.detect(t[a:b])), (t, t[a:b])


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "+1" + " " * 300_000, "1." * 200_000, "@" * 100_000, "one " * 100_000):
        pii.disguised(t, pii.detect(t))


def test_query_and_edges(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_pii_deobfuscated(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "a@b.c", 3), (2, "a@b.c", 3)],
                               "doc_id long, text string, n_email int")
    got = sorted(((r.doc_id, r.n_email, r.spans) for r in pii.find_pii(df).collect()), key=str)
    assert got == [(1, 0, ""), (2, 1, "email:0:5"), (2, 1, "email:0:5"), (None, 0, "")]
    assert pii.find_pii(df.limit(0)).count() == 0
