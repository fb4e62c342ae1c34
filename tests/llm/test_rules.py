"""Measures against plain Python; the plan has no user function."""

import re
from collections import Counter

from scour.llm import rules


def brute(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 5))
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(covered))


ROWS = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b c d"), (5, "a b c d e"), (6, "a b c d e a b c d e"),
        (7, "a a a a a a a"), (8, "x\ny\nx\n\n  \nx"), (9, "#1 *b* <p>|&%$"), (10, "word " * 30000), (10, "word " * 30000),
        (None, "é ü x \U0001f642"), (11, "one two three four five six one two three four five six seven one two three four five")]


def test_measures_and_edges(spark):
    df = spark.createDataFrame([(d, t, True) for d, t in ROWS], "doc_id long, text string, kept boolean")
    got = Counter(tuple(r)[:6] for r in rules.judge(df).collect())
    assert got == Counter((d, *brute(t)) for d, t in ROWS)
    assert rules.judge(df.limit(0)).count() == 0
    kept = rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in rules.judge(df).collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in d.collect()}
    rows = rules.judge(d).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in rows} == want
    for r in rows:
        n, _, _, _, rep = want[r.doc_id]
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in rows if labels.get(r.doc_id) == 0]
    assert all(r.kept for r in clean)
    assert sum(not r.kept for r in junk) > 0.9 * len(junk)


def test_no_python_and_no_shuffle(spark):
    plan = rules.judge(spark.createDataFrame(ROWS, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange", plan.split("Physical Plan")[-1])
