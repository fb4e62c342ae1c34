"""Alignment and deletion against brute force over word windows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scour.llm import linededup as L
from scour.llm import queries
from scour.llm.common import join_heavy, materialize

SF = "/root/testdata/sf0.01"


def split(t):
    return re.findall("[^\x20\x09-\x0D]+", t or "")


def words(rng, n):
    return " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))


def covered(docs, least):
    """docs: {id: text}; of each document the places of words that lie in ``least`` words in a row some earlier document has."""
    first, out = {}, {}
    texts = {d: split(t) for d, t in docs.items()}
    for d in sorted(docs):
        own, gone = [tuple(texts[d][i:i + least]) for i in range(len(texts[d]) - least + 1)], set()
        for i, w in enumerate(own):
            if first.setdefault(w, d) < d:
                gone.update(range(i, i + least))
        out[d] = gone
    return out


def check(docs, rows, least=20):
    """Every window an earlier document has is gone; what else is gone stands in ``gram_words`` words an earlier document has."""
    must, may = covered(docs, least), covered(docs, L.gram_words(least))
    assert len(rows) == len(docs)
    more = 0
    for r in rows:
        old = docs[r.doc_id] or ""
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]
        at = [m.start() for m in re.finditer("[^\x20\x09-\x0D]+", old)]
        gone = {i for i, p in enumerate(at) if any(a <= p < z for a, z in spans)}
        assert must[r.doc_id] <= gone <= may[r.doc_id] | must[r.doc_id]
        assert len(gone) == r.removed_words and len(old) - len(r.text or "") == r.removed_chars == sum(z - a for a, z in spans)
        assert split(r.text) == [w for i, w in enumerate(split(old)) if i not in gone]
        more += len(gone) - len(must[r.doc_id])
    return more


def make(seed):
    rng = random.Random(seed)
    passages = [". ".join(words(rng, rng.randint(3, 12)) for _ in range(rng.randint(3, 8))) + "." for _ in range(6)]
    docs = {}
    for d in range(60):
        parts = [words(rng, rng.randint(1, 15)) + rng.choice([".", "?", "", "!"]) for _ in range(rng.randint(0, 12))]
        for p in rng.sample(passages, rng.choice([0, 1, 1, 2, 3])):
            parts.insert(rng.randint(0, len(parts)), p)
        if rng.random() < 0.2:
            parts += parts[:3]
        docs[d * 3] = rng.choice(["\n", " ", "\n\n", "  "]).join(parts)
    docs[500] = docs[3]
    docs[501] = None
    docs[502] = ""
    docs[503] = "same " * 5000
    docs[504] = "same " * 5000
    return docs


def tangled(seed):
    """Passages cut anywhere, with words changed, in documents with few sentence ends."""
    rng = random.Random(seed)
    passages, docs = [words(rng, rng.randint(15, 120)).split() for _ in range(8)], make(seed)
    for d in range(1000, 1080):
        text = words(rng, rng.randint(0, 30)).split()
        for p in rng.sample(passages, rng.choice([0, 1, 2, 3])):
            a = rng.randint(0, len(p) // 2)
            part = p[a:rng.randint(a, len(p))]
            for _ in range(rng.choice([0, 0, 1, 6])):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs[d] = "".join(w + rng.choice([" "] * 9 + ["! ", "\n", ".\n", "  "]) for w in text)
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_deletes_every_shared_window_of_words(spark, seed):
    docs = tangled(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    check(docs, L.dedup_lines(df).collect())


@pytest.mark.parametrize("seed", [4, 5])
def test_lines_and_repeats(spark, seed):
    docs = make(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    check(docs, L.dedup_lines(df, least=10).collect(), least=10)


def edited():
    """A text, and a copy whose middle has a word changed every twelve words."""
    base = [f"b{i}" for i in range(160)]
    copy = list(base)
    for i in range(52, 110, 12):
        copy[i] = f"new{i}"
    return " ".join(base), " ".join(copy)


def removed(spark):
    a, b = edited()
    rows = L.dedup_lines(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    return {r.doc_id: r.text for r in rows}, check({1: a, 2: b}, rows)


def test_patience_aligns_the_gaps_between_blocks(spark):
    texts, more = removed(spark)
    assert texts[2].split() == ["new52", "new64", "new76", "new88", "new100"] and more == 44


def test_without_patience_the_gaps_stay(spark, monkeypatch):
    monkeypatch.setattr(L, "patience", lambda pairs: [])
    texts, more = removed(spark)
    assert more == 0 and "b60" in texts[2]


@pytest.mark.parametrize("seed", range(20))
def test_gap_blocks_are_common_and_in_order(seed):
    rng = random.Random(seed)
    x = [rng.randint(0, 30) for _ in range(rng.randint(0, 200))]
    y = list(x)
    for _ in range(rng.randint(0, 12)):
        if y:
            i = rng.randrange(len(y))
            y[i:i + rng.randint(0, 9)] = [rng.randint(100, 200)] * rng.randint(0, 9)
    got = sorted(L.gap_blocks(np.array(x, np.uint64), np.array(y, np.uint64), 4))
    at = 0
    for (a, z), after in zip(got, [*got[1:], (len(x), None)]):
        assert z - a >= 4 and z <= after[0]
        places = [i for i in range(at, len(y)) if y[i:i + z - a] == x[a:z]]
        assert places
        at = places[0] + z - a
    if x and x == y and len(x) >= 4 and len({tuple(x[i:i + 4]) for i in range(len(x) - 3)}) == len(x) - 3:
        assert got == [(0, len(x))]


def test_moved_and_repeated_hits_count_and_gaps_lie_between_aligned_ones():
    blocks, gaps = L.align([(0, 30, 20), (50, 0, 20), (80, 60, 20)], 8)
    assert sorted(blocks) == [(0, 20), (50, 70), (80, 100)]
    assert gaps == [(20, 80, 50, 60)] or gaps == [(70, 80, 20, 60)]
    assert L.align([(0, 5, 20), (25, 30, 20)], 8)[1] == [] and L.align([], 8) == ([], [])


def test_passage_inside_a_paragraph_goes_and_the_rest_stays(spark):
    passage = "Alpha beta gamma delta one two three four five six. Seven eight nine ten eleven twelve. " \
              "Thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty end."
    rows = [(7, f"First words here. {passage} Tail of seven."), (9, f"Other start of nine. {passage} And its own end."),
            (2, "Nothing shared. At all."), (None, f"{passage} No id.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, h string")
    out = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    assert out[7].text == rows[0][1] and out[2].text == rows[2][1] and out[7].h == "x"
    assert out[9].text == "Other start of nine. And its own end."
    assert out[None].text == "No id."
    a, z = map(int, out[9].spans.split(":"))
    assert rows[1][1][a:z].strip() == passage and out[9].removed_words == 25


def test_passage_from_mid_sentence_to_mid_sentence_goes(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"It says {passage} and goes on."), (2, f"Who said {passage} here?"),
                                (3, f"Only {passage[:-4]} is short.")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert out == {1: f"It says {passage} and goes on.", 2: "Who said here?", 3: f"Only {passage[:-4]} is short."}


def test_edges(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in L.dedup_lines(df).collect()), key=str)
    assert got == [(1, text), (1, text), (2, ""), (2, ""), (None, "")]
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_clashing_names(spark):
    text = " ".join(f"a{i}" for i in range(30))
    names = ["d", "t", "__d", "__t", "__bd", "cuts", "__cuts", "row", "key", "h", "g", "weight", "parts", "spans", "Removed_Words", "a.b"]
    df = spark.createDataFrame([(1, text, *range(len(names))), (2, text, *range(len(names)))], ["doc_id", "text", *names])
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "_spans", "_removed_words", "removed_chars"]
    assert all(tuple(r)[2:2 + len(names)] == tuple(range(len(names))) for r in out.collect())
    assert {r.doc_id: r.text for r in out.collect()} == {1: text, 2: ""}


def test_every_shared_window_of_the_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_line_alignment(spark, SF)
    assert rows.columns == ["doc_id", "removed_words", "removed_chars", "removed_spans", "kept_md5"]
    must = covered(docs, 20)
    got = {r.doc_id: r.removed_words for r in rows.collect()}
    assert len(got) == len(docs) and all(got[d] >= len(m) for d, m in must.items()) and sum(n > 0 for n in got.values()) > 20
    check(docs, L.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect())


def test_heavy_keys_join_like_others(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).alias("k"), "id")
    table = materialize(rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2).where("k <> 5"), "heavy")
    got = join_heavy(rows, table, "k", "n")
    want = rows.join(table, "k")
    assert sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, want.select("k", "id", "v").collect()))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_copies_of_whole_texts_take_no_steps(spark, monkeypatch):
    rng = random.Random(5)
    long, other, short = (" ".join(f"é{c}{rng.randrange(10 ** 9)}" for _ in range(n)) for c, n in (("a", 300), ("b", 100), ("c", 12)))
    docs = dict(enumerate([long] * 20 + [other] * 5 + [short] * 3 + ["", None, " \n" + " ".join(f"x{i}" for i in range(50))]))
    docs[40] = docs[41] = docs[30] + "  "
    docs[50] = short + " " + " ".join(f"y{i}" for i in range(40))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    counts, real = {}, L.materialize

    def counted(rows, name, **options):
        out = real(rows, name, **options)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(L, "materialize", counted)
    rows = L.dedup_lines(df).collect()
    check(docs, rows)
    # only the fifty words that stand in 30 and, with other blanks, in 40 are looked at
    assert counts["lines-blocks"] == 1 and 0 < counts["lines-runs"] < 20
    monkeypatch.setattr(L, "KNOWN", 1)  # copies of other texts go the long way, to the same end
    assert sorted(map(str, L.dedup_lines(df).collect())) == sorted(map(str, rows)) and counts["lines-blocks"] == 6
