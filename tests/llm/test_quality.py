"""Held-out accuracy, the risk's gradient, and what a score may depend on."""

import zlib

import numpy as np

from scour.llm import quality, queries


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    n1, n0 = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op4_pu_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 10000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in test])
    assert auc(np.array([r.score for r in test]), y) > 0.98
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality", "toxic")
    a = {r.doc_id: round(r.score, 9) for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: round(r.score, 9) for r in quality.classify(docs, flipped).collect()}
    assert a == b


def test_gradient_of_the_risk(spark):
    rng = np.random.default_rng(0)
    x = rng.random((60, quality.WIDTH)).astype(np.float32)
    rows = [(r.tobytes(), bool(i % 3 == 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "x binary, trusted boolean")
    w = rng.normal(size=quality.WIDTH + 1) * 0.1
    model = quality.Linear(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), w)
    got = quality.risk_parts(df, model)
    trusted = np.array([t for _, t in rows])

    def unbiased(w):
        g = quality.Linear(model.mean, model.std, w).margin(x.astype(float))
        return 0.7 * np.logaddexp(0, -g[trusted]).mean() + np.logaddexp(0, g).mean() - 0.7 * np.logaddexp(0, g[trusted]).mean()

    assert np.isclose(unbiased(w), 0.7 * got["p_pos"] + got["u_neg"] - 0.7 * got["p_neg"])
    grad = got["u_grad"] - 0.7 * got["p_mean"]
    for i in (0, 5, quality.WIDTH):
        e = np.zeros(quality.WIDTH + 1)
        e[i] = 1e-5
        assert np.isclose((unbiased(w + e) - unbiased(w - e)) / 2e-5, grad[i], atol=1e-6)


def test_fit_where_the_negative_part_is_clamped(spark):
    """Few trusted rows of many unlabelled and a high prior: the risk comes near that of a slow, dense optimiser."""
    rng = np.random.default_rng(3)
    n, prior = 80, 0.9
    x = rng.normal(size=(n, quality.WIDTH)).astype(np.float32)
    trusted = np.arange(n) < 12
    df = spark.createDataFrame([(r.tobytes(), bool(t)) for r, t in zip(x, trusted)], "x binary, trusted boolean").coalesce(2).cache()
    z = np.hstack([x.astype(float), np.ones((n, 1))])
    reg = np.full(quality.WIDTH + 1, quality.RIDGE)
    reg[-1] = 0

    def risk(w):
        g = z @ w
        neg = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, g[trusted]).mean()
        s = quality.sigmoid(g)
        grad = prior * ((s[trusted] - 1)[:, None] * z[trusted]).mean(0) + reg * w
        if neg > 0:
            grad = grad + (s[:, None] * z).mean(0) - prior * (s[trusted][:, None] * z[trusted]).mean(0)
        return prior * np.logaddexp(0, -g[trusted]).mean() + max(0.0, neg) + 0.5 * (reg * w * w).sum(), grad, neg

    best, w, m, v, clamped = np.inf, np.zeros(quality.WIDTH + 1), 0, 0, 0
    for i in range(20_000):
        r, grad, neg = risk(w)
        best, clamped = min(best, r), clamped + (neg < 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w = w - 0.02 / (1 + i / 2000) * (m / (1 - 0.9 ** (i + 1))) / (np.sqrt(v / (1 - 0.999 ** (i + 1))) + 1e-9)
    start = quality.Linear(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), np.zeros(quality.WIDTH + 1))
    got = quality.fit(df, start, prior, steps=40)
    mine = risk(got.w)[0]
    assert clamped > 1000 and risk(np.zeros_like(w))[0] - best > 0.2
    assert mine <= best + 0.03, (mine, best)


def test_slopes_are_the_risk_s(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, quality.WIDTH)).astype(np.float32)
    trusted = np.arange(40) % 4 == 0
    df = spark.createDataFrame([(r.tobytes(), bool(t)) for r, t in zip(x, trusted)], "x binary, trusted boolean")
    w = rng.normal(size=quality.WIDTH + 1) * 0.2
    model = quality.Linear(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), w)
    grad, curve = quality.slope(quality.risk_parts(df, model), 0.6, True)

    def at(w):
        return 0.6 * np.logaddexp(0, -quality.Linear(model.mean, model.std, w).margin(x.astype(float))[trusted]).mean()

    for i in (0, 7, quality.WIDTH):
        e = np.zeros(quality.WIDTH + 1)
        e[i] = 1e-4
        assert np.isclose((at(w + e) - at(w - e)) / 2e-4, grad[i], atol=1e-6)
        assert np.isclose((at(w + e) + at(w - e) - 2 * at(w)) / 1e-8, curve[i, i], atol=1e-4)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "some words", 0.1), (4, "a b " * 40000, 0.1), (4, "a b " * 40000, 0.1),
                                  (6, "plain text. Of words.", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(6, 1), (6, None), (4, 1), (4, 0), (None, 1), (1, 1)], "doc_id long, quality int")
    rows = quality.classify(docs, odd).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and not [r for r in rows if r.doc_id is None][0].held_out
    assert quality.classify(docs.limit(0), odd).count() == 0
