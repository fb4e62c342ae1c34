"""Each stage of the pipeline against brute force on its own input, and the stages' contract."""

import math
import os

import test_linededup
import test_mixing
import test_packing
import test_rules
import test_simhash
from pyspark.sql import functions as F

import corpus_pipeline
from scour.llm import mixing, rules
from scour.session import clean_scratch, scratch_path

SF = "/root/testdata/sf0.001"


def verdict(text):
    """The rules, by hand."""
    t = text or ""
    n, chars, symbols, dups, repeats = test_rules.brute(t)
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    words = t.replace("\x0b", " ").replace("\x0c", " ").split()
    stops = sum(w.lower() in rules.STOP_WORDS for w in words)
    m = {"mean_word_chars": chars / n if n else 0, "symbols_per_word": symbols / n if n else 0,
         "shouts_per_word": sum(c in "!?" for c in t) / n if n else 0, "stop_word_ratio": stops / n if n else 0,
         "dup_line_ratio": dups / len(lines) if lines else 0,
         "bullet_line_ratio": sum(x.strip()[:1] in "-*•‣·" for x in lines) / len(lines) if lines else 0,
         "ellipsis_line_ratio": sum(x.rstrip().endswith(("...", "…")) for x in lines) / len(lines) if lines else 0}
    if n < 10 or 100 * repeats > 20 * n:
        return False
    return not any(n >= r.least and (r.low is not None and m[r.measure] < r.low or r.high is not None and m[r.measure] > r.high)
                   for r in rules.RULES)


def mixture(rows):
    """{doc_id: copies} with the last document of a source whole where that comes nearer."""
    size = lambda t: len((t or "").split())
    sizes, out = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    aim = test_mixing.targets(sizes)
    for s in sizes:
        def key(r):
            u = (int(__import__("hashlib").md5(f"0:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            return -math.log(u) * (1 + sum(c in mixing.NOISE for c in r[1] or "") / max(size(r[1]), 1))
        epochs = int(aim[s] // sizes[s])
        left = math.floor(aim[s] - epochs * sizes[s] + 0.5)
        for r in sorted((r for r in rows if r[2] == s), key=key):
            n = size(r[1])
            out[r[0]] = epochs + (left >= n if left != n else left > 0) if left <= 0 or left >= n else epochs + (2 * left > n)
            left -= n
    return {d: n for d, n in out.items() if n}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        rows_in = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(path := f"{tmp_path}/{i}")
        docs = spark.read.parquet(path)
        rows = docs.collect()
        seen[name] = len(rows)
        if i < 4:
            assert docs.columns == names
        if i == 0:
            assert {r.doc_id for r in rows} == {d for d, r in before.items() if verdict(r.text)}
            assert all(r == before[r.doc_id] for r in rows)
        elif i == 1:
            must = test_linededup.covered({d: r.text for d, r in before.items()}, 20)
            may = test_linededup.covered({d: r.text for d, r in before.items()}, 8)
            after = {r.doc_id: r for r in rows}
            for d, r in before.items():
                words = test_linededup.split(r.text)
                if d in after:
                    kept = test_linededup.split(after[d].text)
                    assert kept and len(words) - len(may[d]) <= len(kept) <= len(words) - len(must[d])
                else:
                    assert len(may[d]) == len(words)
            assert all(r.n_chars == len(r.text) or r.text == before[r.doc_id].text for r in rows)
        elif i == 2:
            pairs = [(r.doc_id, test_simhash.brute_fp(r.text)) for r in rows_in]
            assert {r.doc_id for r in rows} == set(test_simhash.brute_components(pairs)) and len(rows) == len({r.doc_id for r in rows})
        elif i == 3:
            got = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
                assert r == before[r.doc_id]
            assert got == mixture([(r.doc_id, r.text, r.source) for r in rows_in])
        else:
            test_packing.check(rows, [(r.doc_id, r.text) for r in rows_in], 2048)
    assert seen["quality rules"] < 200 and seen["simhash near-dedup"] <= seen["line dedup"]


def test_run_and_empty(spark, tmp_path):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns)
    spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


#: Names that the operators use for columns of their own.
HELPERS = ["row", "d", "t", "d1", "t1", "cuts", "parts", "spans", "removed_words", "removed_chars", "__removed_words", "__spans", "__d", "__t", "__bd",
           "__cuts", "__text", "__words", "__lines", "__id", "__th", "__n", "__size", "__key", "__bin", "__row", "__part", "__begin", "__ids", "id", "th", "n",
           "fp", "root", "key", "h", "g", "a", "z", "weight", "size", "copies", "part", "component_id", "target", "start", "length", "offset", "text_", "a.b"]


def test_stages_take_odd_rows(spark):
    text = " ".join(f"the word{i} of" for i in range(12)) + "."
    rows = [(None, text, None, "a", None), (1, None, "en", None, 3), (2, "", "en", "a", 0), (3, text, None, "b", 9), (3, text, None, "b", 9),
            (4, text + " And the other one of it.", "de", None, 1)]
    rows = [(*r, *(f"{i}:{c}" for c in HELPERS)) for i, r in enumerate(rows)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in HELPERS)
    docs, out = spark.createDataFrame(rows, kinds), None
    for _, stage in corpus_pipeline.STAGES:
        names = docs.columns
        out = stage(spark, docs, SF)
        for r in out.collect():
            if "sequence_id" not in out.columns:
                own = tuple(r)[5:]
                assert {v.split(":", 1)[1]: c for c, v in zip(HELPERS, own)} == {c: c for c in HELPERS} and len({v.split(":")[0] for v in own}) == 1
        if "sequence_id" not in out.columns:
            assert out.columns == names
            docs = out
    assert out.count() > 0


def test_run_leaves_no_table_of_an_earlier_stage(spark):
    corpus_pipeline.run(spark, SF).collect()
    clean_scratch(spark)
    rows = corpus_pipeline.run(spark, SF)
    root = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    left = [d for d in os.listdir(root) if d.startswith("pipeline-")]
    assert left == [d for d in left if "mixing" in d] and len(left) == 1
    assert not [d for d in os.listdir(root) if d.startswith(("lines-", "simhash-", "mix-"))]
    assert rows.count() > 0
