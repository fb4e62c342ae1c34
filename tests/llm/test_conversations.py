"""Repair against an exhaustive shortest-path search over edit strings, row by row."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scour.llm import conversations as C
from scour.llm import queries

SF = "/root/testdata/sf0.01"
WS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """rows: (role, text, must_go, cut); (cost, audit, repaired rows) by Dijkstra over (cost, audit)."""
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        key = (i, roles)
        if key in done:
            continue
        done.add(key)

        def go(c, x, j, role=None, text=""):
            new = roles if role is None else roles + role[:1]
            if role is not None and (not role or not re.fullmatch("s?(ua)*u?", new)):
                return
            new = "ua" if new.endswith("ua") else "u" if new.endswith("u") else new  # all that the rest depends on
            heapq.heappush(heap, (cost + c, audit + x, j, new, out if role is None else [*out, f"{role}:{text}"]))
        for role in ("user", "assistant"):
            go(3, "I", i, role)
        if i < len(rows):
            role, text, must_go, cut = rows[i]
            go(4, "D", i + 1)
            if not must_go:
                go(3 * cut, "K", i + 1, role, text)
                for new in ("user", "assistant"):
                    go(3 + 3 * cut, "R", i + 1, new, text)


def brute(rows):
    """rows after damage: (turn, role, text); all columns but conv_id."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, coded, n = set(), [], {"blank": 0, "dup": 0, "cut": 0}
    for _, role, text in rows:
        last = text.strip(WS)[-1:]
        blank, dup, cut = not last, (role, text) in seen, last not in ".!?" or not last
        seen.add((role, text))
        n["blank"] += blank
        n["dup"] += dup and not blank
        n["cut"] += cut and not blank and not dup
        coded.append((role, text, blank or dup, cut))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, out = cheapest(coded)
    return (gaps, n["blank"], n["dup"], n["cut"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    """{conv_id: rows} of (conv_id, turn, role, text), by the contract."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        sp = [" " if x is None else x for x in (conv, turn, role, text)]
        role, text = sp[2], sp[3]
        h = zlib.crc32(f"{sp[0]}:{sp[1]}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def rows_of(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {k: brute(v) for k, v in damaged(rows).items()}
    df = queries.op12_conversation_repair(spark, SF)
    got = df.collect()
    assert len(got) == len(want) and {r[0]: tuple(r[1:]) for r in got} == want
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {c for r in got for c in r.audit} == set("DIKR") and any(r.illegal and not r.cost for r in got) is False


@pytest.mark.parametrize("seed", range(3))
def test_odd_conversations(spark, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "unit", "speaker", "aide"]
    texts = ["Yes.", "No!", "well", "", "  \n", None, "Done? \t", "\x0b.\x0c", "x" * 50 + ".", "é…"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(6), 9, 30]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts))
            for _ in range(600)]
    rows += [(100, 0, "user", "x" * 100_000), (100, 1, "assistant", "."), *[(101, t, "user", f"q{t}.") for t in range(700)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(1)).withColumn("alive", F.lit(False)) \
        .withColumn("kind", F.lit("x")).repartition(5)
    want = {k: brute(v) for k, v in damaged(rows).items()}
    assert rows_of(C.repair(C.damage(df))) == want
    plain = {}
    for c, t, r, x in rows:
        plain.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    assert rows_of(C.repair(df.drop("alive"))) == {k: brute(v) for k, v in plain.items()}


def test_a_conversation_that_loses_all_rows_and_empty_tables(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert rows_of(C.repair(C.damage(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.repair(C.damage(df.limit(0))).count() == 0


def test_search_does_not_depend_on_its_bounds():
    rng = random.Random(5)
    for _ in range(400):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randint(0, 9)))
        got = C.search(codes)
        assert got == C.search(codes, C.NoBounds)
        names = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
        assert got == cheapest([(names[c % 4], "", c == 8, 4 <= c < 8) for c in codes])[:2]


def test_ties_are_ascii_least():
    assert C.search(bytes([2])) == (3, "IK") and C.search(bytes([1])) == (3, "KI")
    assert C.search(bytes([0])) == (4, "D") and C.search(bytes([1, 1])) == (3, "KR")


def test_long_conversations_take_linear_time():
    codes = bytes(random.Random(1).choice([0, 1, 2, 3, 5, 6, 8]) for _ in range(200_000))
    cost, audit = C.search(codes)
    assert len(audit.replace("I", "")) == len(codes) and 0 < cost <= 4 * len(codes)
