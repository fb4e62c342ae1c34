"""Parts and rules against plain Python, the model against a dictionary of counts."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scour.llm import queries, urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:n], rest[n:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return host, tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def rule(host, path):
    fit = []
    for r in urls.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append(r)
    return max(fit, key=len, default=None)


ODD = [None, "", "no scheme", "http://", "HTTP://A.ORG", "http://A.ORG/", "http://a.org?x=/", "http://example.org/es/1", "http://x.example.org/en/1#f",
       "http://xexample.org/en/1", "http://example.org/en/2", "https://b.com/fr", "https://b.com/fr/?q", "https://b.com/de/\n/x", "http://com/de/",
       "x://a.net/b://c.org/d", "http://É.ORG/a", "http://u@a.org:80/", "://a.org/p"]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(ODD)], "page_id long, url string, host string")
    rows = urls.judge(df).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.host, r.path) == parts(ODD[r.page_id]), ODD[r.page_id]
        assert r.rule == rule(r.host, r.path)
        assert r.verdict == urls.RULES[r.rule] if r.rule else r.verdict in ("allow", "block")


def test_no_training_data_allows(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in urls.judge(df).collect()] == ["allow"] * 3
    assert urls.judge(df.limit(0)).count() == 0


def test_query_string_and_urls_without_scheme_reach_the_model(spark):
    seen = [f"https://a{i}.example.org/{k}/1{i}?from={v}" for i in range(20) for k, v in (("en", "xxx"), ("de", "yyy"))]
    ask = ["http://h.net/?from=xxx", "http://h.net/?from=yyy", "no scheme", "other text"]
    df = spark.createDataFrame(list(enumerate(seen + ask)), "page_id long, url string")
    r = [x.ratio for x in sorted(urls.judge(df).collect(), key=lambda x: x.page_id)[len(seen):]]
    assert r[0] < r[1] and r[2] != r[3]


def brute_ratios(told, texts):
    """Witten-Bell over whole, unfolded texts by dictionaries; told: {kind: texts}."""
    def p(seen):
        n, ctx = Counter(), {}
        for t in seen:
            x = urls.START * urls.ORDER + t + urls.END
            for i in range(urls.ORDER, len(x)):
                for k in range(urls.ORDER + 1):
                    n[x[i - k:i + 1]] += 1
        for g, v in n.items():
            total, kinds = ctx.get(g[:-1], (0, 0))
            ctx[g[:-1]] = total + v, kinds + 1

        def logp(t):
            x, out = urls.START * urls.ORDER + t + urls.END, 0.0
            for i in range(urls.ORDER, len(x)):
                q = 1 / urls.SYMBOLS
                for k in range(urls.ORDER + 1):
                    total, kinds = ctx.get(x[i - k:i], (0, 0))
                    if total:
                        q = (n[x[i - k:i + 1]] + kinds * q) / (total + kinds)
                out += math.log(q)
            return out
        return logp

    a, b = p(told["allow"]), p(told["block"])
    return {t: (a(t) - b(t)) / (len(t) + 1) for t in texts}


def fold(spark, texts):
    df = spark.createDataFrame([(t,) for t in set(texts)], "t string")
    return {r.t: r.f for r in df.select("t", F.pmod(F.xxhash64("t"), F.lit(urls.FOLDS)).alias("f")).collect()}


def judged(spark, rows, pages):
    """Ratios and verdicts of all rows (page_id, rule, ratio, verdict, ...) against dictionaries; ``pages``: {page_id: url}."""
    texts = {i: u or "" for i, u in pages.items()}
    told, free = {"allow": [], "block": []}, []
    for u in texts.values():
        r = rule(*parts(u))
        (told[urls.RULES[r]] if r else free).append(u)
    want, folds = brute_ratios(told, free), fold(spark, texts.values())
    unseen = {"allow": [], "block": []}
    for f in range(urls.FOLDS):
        rest = {k: [t for t in v if folds[t] != f] for k, v in told.items()}
        for k, v in told.items():
            mine = [t for t in v if folds[t] == f]
            got = brute_ratios(rest, mine)
            unseen[k] += [got[t] for t in mine]
    assert sorted(r.page_id for r in rows) == sorted(pages)
    lows, highs = [], []
    for r in rows:
        u = texts[r.page_id]
        assert (r.host, r.path, r.rule) == (*parts(u), rule(*parts(u)))
        if r.rule:
            assert r.verdict == urls.RULES[r.rule] and r.ratio is None
        else:
            assert math.isclose(r.ratio, want[u], rel_tol=1e-9, abs_tol=1e-11), u
            (highs if r.verdict == "allow" else lows).append(r.ratio)
    # the verdicts part at one ratio, which parts the unseen training URLs as well as any
    low, high = max(lows, default=-math.inf), min(highs, default=math.inf)
    assert low < high

    def wrong(cut):
        return sum(x < cut for x in unseen["allow"]) / len(unseen["allow"]) + sum(x >= cut for x in unseen["block"]) / len(unseen["block"])

    cuts = [low + 1e-12, high, *(x for v in unseen.values() for x in v if low < x <= high)]
    assert min(map(wrong, (c for c in cuts if math.isfinite(c)))) <= min(map(wrong, unseen["allow"] + unseen["block"])) + 0.02
    return lows, highs


def test_models_read_whole_unfolded_urls(spark):
    seen = [f"https://a{i}.example.org/en/{d}{i}?from={'x' if d == 1 else 'y'}" for i in range(30) for d in (1, 2, 9)]
    ask = ["http://h.example.net/en/1651", "http://h.example.net/en/2651", "http://h.example.net/q?from=x", "http://h.example.net/q?from=y",
           "no scheme é", "other text", None, "", "日本語 " * 20]
    pages = dict(enumerate(seen + ask))
    df = spark.createDataFrame(list(pages.items()), "page_id long, url string").withColumn("h", F.lit(1)).withColumn("kind", F.lit("x")).repartition(4)
    rows = urls.judge(df).collect()
    judged(spark, rows, pages)
    got = {r.page_id: r.ratio for r in rows}
    n = len(seen)
    assert got[n] < got[n + 1] and got[n + 2] < got[n + 3] and got[n + 4] != got[n + 5] and got[n + 6] == got[n + 7]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op7_url_markov(spark, sf)
    assert rows.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    lows, highs = judged(spark, rows.collect(), pages)
    assert lows and highs


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_contexts_over_the_edges_of_ranges(spark, ranges):
    seen = [f"https://a{i % 5}.example.org/{p}/{i}" for i in range(40) for p in ("es", "fr")] + ["https://x.org/aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    pages = dict(enumerate([*seen, "http://b.net/es/1", "http://b.net/fr/aaaaaaaaaaaaaaaa"]))
    df = spark.createDataFrame(list(pages.items()), "page_id long, url string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = urls.judge(df).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    judged(spark, rows, pages)
