"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text (every document, label unseen) train a
logistic model ``g`` by the non-negative unbiased risk

    pi * E_P[l(g)]  +  max(0, E_U[l(-g)] - pi * E_P[l(-g)]),      l(z) = log(1 + exp(-z)),

where ``pi`` is the share of positives among the unlabelled, estimated from the
data: for scores above any bar, U's share is at least ``pi`` times P's, so the least
ratio of the two over the bars is an upper estimate, tight where no negative
reaches.  No negative label is ever used.

The features are shape statistics of a whole text (case, symbols, repetition,
words, lines), never its id, source, language or labels.  They are computed once
and written; every Newton step is one pass over all rows in which each task adds
up its own loss, gradient and curvature, so only sums of fixed size travel.

Edge cases: null and empty texts have all-zero features and get a score like any
other; labels with a null quality are no labels, and a document whose labels
disagree is not trusted; repeated rows count each; without trusted positives
every score is 0.5; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

FOLDS, HELD_OUT = 3, 1
STEPS, RIDGE, START_PRIOR = 12, 1e-2, 0.5
#: Bars of the prior estimate lie where at least this share of the positives is above.
LEAST_ABOVE = 0.75
#: Standard errors by which each ratio is raised, so that the least one is not a lucky one.
CAUTION = 3.0
BINS = 512

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
MARKS = (b"#*$%&", b"|<>", b"!?", b".", b",", b"\"'()[]{}=;:/@_~^+-")
#: What each ratio is divided by before it is cut to 1: one gentle and one steep copy of each.
SCALES = (0.1, 1.0)
NAMES = ["upper", "digits", "marks0", "marks1", "marks2", "marks3", "marks4", "marks5", "other", "same_as_last", "new_words",
         "common_word", "dup_lines"]
WIDTH = len(NAMES) * len(SCALES) + 8


def features(text: str | None) -> np.ndarray:
    out = np.zeros(WIDTH, np.float32)
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return out

    def count(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    n, size = len(words), sum(map(len, words))
    upper, lower = count(UPPER), count(LOWER)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = [count(m) for m in MARKS]
    same = sum(map(operator.eq, words, words[1:]))
    ratios = [upper / (upper + lower + 1), count(DIGITS) / size, *(m / n for m in marks),
              (size - upper - lower - sum(marks)) / size, same / n, 1 - len(tally) / n, max(tally.values()) / n,
              1 - len(set(lines)) / len(lines)]
    out[:len(NAMES) * len(SCALES)] = [min(r / s, 1.0) for r in ratios for s in SCALES]
    mean = size / n
    out[-8:] = [1.0, min(np.log(n) / 10, 1.0), min(n / 10, 1.0), min(n / 100, 1.0), min(mean / 10, 2.0), min(abs(mean - 5) / 5, 1.0),
                min(size / len(lines) / 1000, 1.0), float(n < 20) * same / n]
    return out


def describe(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep`` columns and x (float32 features, packed) of every row."""
    src = docs.select(*keep, text)
    types = dict(src.dtypes)

    def run(batches):
        for b in batches:
            x = [features(t).tobytes() for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.binary())], [*keep, "x"])

    return src.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "x binary"]))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)


def sums(table: DataFrame, size: int, add) -> np.ndarray:
    """``add(x, trusted)`` (an array of ``size`` numbers) summed over all rows of (x, trusted)."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += add(matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "v"])

    out = np.zeros(size)
    for r in table.select("x", "trusted").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class Linear:
    """g(x) = w . (x - mean) / std + b, the last weight being b."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, w: np.ndarray):
        self.mean, self.std, self.w = mean, std, w

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.std, np.ones((len(x), 1))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.w


def risk_parts(table: DataFrame, model: Linear) -> dict:
    """Means over U and P that the risk, its gradient and its curvature need, from one pass."""
    d = WIDTH + 1

    def add(x, trusted):
        z = model.design(x)
        g = z @ model.w
        s = sigmoid(g)
        p, q, bend = z[trusted], s[trusted], (s * (1 - s))[:, None] * z
        return np.concatenate([[len(z), len(p), softplus(g).sum(), softplus(g[trusted]).sum(), softplus(-g[trusted]).sum()],
                               (s[:, None] * z).sum(0), p.sum(0), (q[:, None] * p).sum(0), bend.T.dot(z).ravel(), bend[trusted].T.dot(p).ravel()])

    t = sums(table, 5 + 3 * d + 2 * d * d, add)
    n, m = max(t[0], 1), max(t[1], 1)
    u_grad, p_mean, p_grad = (t[5 + i * d:5 + (i + 1) * d] for i in range(3))
    curves = t[5 + 3 * d:].reshape(2, d, d)
    return {"u_neg": t[2] / n, "p_neg": t[3] / m, "p_pos": t[4] / m, "u_grad": u_grad / n, "p_mean": p_mean / m, "p_grad": p_grad / m,
            "curve": curves[0] / n, "p_curve": curves[1] / m}


def slope(parts: dict, prior: float, clamped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the risk without its ridge, where the negative part counts or is clamped to zero."""
    if clamped:  # the positive part alone: the gradient of l(g) is (s - 1) z
        return prior * (parts["p_grad"] - parts["p_mean"]), prior * parts["p_curve"]
    # for the logistic loss l(g) - l(-g) = -g, so P enters the unbiased gradient through its mean alone
    return parts["u_grad"] - prior * parts["p_mean"], parts["curve"]


def fit(table: DataFrame, start: Linear, prior: float, steps: int = STEPS) -> Linear:
    """Newton steps on the non-negative risk, shortened while they do not lower it.

    Where the negative part is below zero it is clamped, and the step follows the gradient of what is left; where
    that does not lower the risk, as at the edge between the two, the step of the other side is tried.
    """
    reg = np.full(WIDTH + 1, RIDGE)
    reg[-1] = 0

    def negative(parts):
        return parts["u_neg"] - prior * parts["p_neg"]

    def risk(parts, w):
        return prior * parts["p_pos"] + max(0.0, negative(parts)) + 0.5 * (reg * w * w).sum()

    def lower(model, parts, now, clamped):
        grad, curve = slope(parts, prior, clamped)
        step = np.linalg.solve(curve + np.diag(reg + 1e-9), grad + reg * model.w)
        scale = min(1.0, 20.0 / (np.abs(step).max() + 1e-12))
        for _ in range(5):
            trial = Linear(model.mean, model.std, model.w - scale * step)
            got = risk_parts(table, trial)
            if risk(got, trial.w) < now:
                return trial, got
            scale /= 4
        return None

    model, parts = start, risk_parts(table, start)
    for _ in range(steps):
        now, clamped = risk(parts, model.w), negative(parts) < 0
        found = lower(model, parts, now, clamped) or lower(model, parts, now, not clamped)
        if found is None:
            break
        model, parts = found
        if now - risk(parts, model.w) < 1e-6:
            break
    return model


def estimate_prior(table: DataFrame, model: Linear) -> float:
    """Least ratio of U's share to P's share above a bar, over bars that leave enough of P above."""

    def add(x, trusted):
        bins = np.clip((sigmoid(model.margin(x) / 4) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(bins, minlength=BINS), np.bincount(bins[trusted], minlength=BINS)]).astype(float)

    h = sums(table, 2 * BINS, add)
    u, p = (np.cumsum(x[::-1])[::-1] / max(x.sum(), 1) for x in (h[:BINS], h[BINS:]))
    n, m = h[:BINS].sum(), h[BINS:].sum()
    bars = p >= LEAST_ABOVE
    if not bars.any():
        return START_PRIOR
    u, p = u[bars], p[bars]
    # relative standard error of the ratio of two shares
    error = np.sqrt((1 - u) / (u * n + 1e-9) + (1 - p) / (p * m + 1e-9))
    best = np.argmin(u / p * (1 + CAUTION * error))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def train(table: DataFrame) -> tuple[Linear, float] | None:
    """Model and prior from (x, trusted); None without trusted rows."""
    t = sums(table, 2 + 2 * WIDTH, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)]))
    if not t[1]:
        return None
    mean = t[2:2 + WIDTH] / t[0]
    std = np.sqrt(np.maximum(t[2 + WIDTH:] / t[0] - mean ** 2, 0))
    model = Linear(mean, np.where(std > 1e-6, std, 1.0), np.zeros(WIDTH + 1))
    prior = START_PRIOR
    for _ in range(2):
        model = fit(table, model, prior)
        prior = estimate_prior(table, model)
    return fit(table, model, prior), prior


def trusted(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Ids of trusted positives: every label says 1, and the id is not in the held-out fold."""
    return (labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
            .groupBy(F.col(doc_id).alias("__id")).agg(F.min(quality).alias("low")).where("low = 1")
            .select("__id", F.lit(True).alias("trusted")))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    plain = materialize(describe(src, ("doc_id",)), "pu-features")
    known = trusted(labels)
    table = materialize(plain.join(known, plain.doc_id == known["__id"], "left").select(
        "doc_id", "x", F.coalesce("trusted", F.lit(False)).alias("trusted")), "pu-rows")
    got = train(table)
    model = got[0] if got else Linear(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1))

    def run(batches):
        for b in batches:
            s = sigmoid(model.margin(matrix(b.column(1)))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    kind = dict(src.dtypes)["doc_id"]
    out = table.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
