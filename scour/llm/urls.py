"""URL filter: rules first, then a character language-model ratio.

URLs that a rule accepts or rejects train two variable-order Markov models of
characters; a URL that no rule fits is judged by the difference of its
log-likelihoods under the two, divided by its length, against a threshold
calibrated on URLs the models have not seen: the training URLs are dealt to ``FOLDS``
folds by their text, and each is scored by models of the other folds.

The models read the whole url text as it stands, character by character; host and
path are for the rules alone.  Contexts have 0 to ``ORDER`` characters.  Smoothing is
Witten-Bell: order ``n`` gives way to order ``n - 1`` by the number of distinct characters
seen in its context, down to the uniform distribution.

Counts grow with the URLs and are never gathered.  What is shuffled is the table of
distinct windows (a character and the ``ORDER`` before it), once: it is cut into ranges
and sorted by the reversed context, so that every context of every order is one stretch of
rows, and all orders are counted in place.  Contexts that reach over the edge of a range
(at most two an order and range) are added up over the ranges and given back to them.
No key is hot: windows are distinct, and ranges are cut by rows.  Only the histogram of
ratios (``BINS``) reaches the driver.

Edge cases: a null url or one without "://" has empty host and path, so no rule
fits, and is judged by the model as its text (null as the empty one); repeated rows are judged (and counted) each; with
no accepted or no rejected URL to learn from there is nothing to tell apart and
the verdict is ``allow``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, materialize

ORDER = 12
#: Characters a text can go on with: any code point or the end mark.
SYMBOLS = 0x110000 + 1
START, END = "\x02", "\x03"
#: Score bins of the calibration, and its folds.
BINS, FOLDS = 4000, 3
KINDS = ("allow", "block")
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null: longer rules are asked first."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        h, p = r.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(r)).otherwise(out)
    return out


#: A window's counts: by kind and, in it, by fold.
COUNTS = [f"n{i}" for i in range(len(KINDS) * FOLDS)]


def endings(t: str) -> tuple[list[str], str]:
    """The reversed contexts of a text's characters, the end mark included, and these characters."""
    x = t + END
    back = x[::-1] + START * ORDER
    n = len(x)
    return [back[k:k + ORDER] for k in range(n, 0, -1)], x


def windows(rows: DataFrame) -> DataFrame:
    """(rev, x, n0, ..., weight) over rows (kind, fold, text): the windows of each batch of rows, with how often each kind and
    fold has them, and how often they stand there at all."""

    def run(batches):
        for b in batches:
            seen: dict[tuple[str, str], int] = {}
            rev, x, at, slot, weight = [], [], [], [], []
            for kind, fold, t in zip(*(c.to_pylist() for c in b.columns)):
                own = -1 if kind is None else KINDS.index(kind) * FOLDS + fold
                for w in zip(*endings(t)):
                    i = seen.setdefault(w, len(seen))
                    if i == len(rev):
                        rev.append(w[0])
                        x.append(w[1])
                        weight.append(0)
                    weight[i] += 1
                    if own >= 0:
                        at.append(i)
                        slot.append(own)
            n = np.bincount(np.array(at, np.int64) * len(COUNTS) + np.array(slot, np.int64), minlength=len(rev) * len(COUNTS)).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([pa.array(rev, pa.string()), pa.array(x, pa.string()), *(pa.array(np.ascontiguousarray(c)) for c in n.T.astype(np.int64)),
                                              pa.array(weight, pa.int64())], ["rev", "x", *COUNTS, "weight"])

    return rows.select("kind", "fold", "text").mapInArrow(run, "rev string, x string, " + ", ".join(f"{c} long" for c in (*COUNTS, "weight")))


def code_points(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width code points."""
    return np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, width)


def ranges(batches):
    """(part, rev, x, counts, ghosts) of each whole range; ghosts are the rows with k, what other ranges have of its edge contexts."""
    held, now = [], None
    for b in batches:
        part = b.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and part[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(part[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def shared(rev: np.ndarray) -> np.ndarray:
    """How many of its context's nearest characters a row shares with the row before."""
    same = np.zeros((len(rev), ORDER + 1), bool)
    same[1:, :ORDER] = rev[1:] == rev[:-1]
    return same.argmin(1)


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    cols = [table.column(c).combine_chunks() for c in ("rev", "x")]
    counts = np.stack([table.column(c).to_numpy() for c in COUNTS], 1)
    return code_points(cols[0], ORDER), code_points(cols[1], 1)[:, 0].astype(np.int64), counts


def edges(table: DataFrame) -> DataFrame:
    """(part, k, context, x, n0, ...): what each range has of the contexts of its first and last row, by order."""

    def run(batches):
        for part, t in ranges(batches):
            rev, x, counts = unpack(t)
            like, text = shared(rev), t.column("rev")
            first, last = text[0].as_py(), text[len(rev) - 1].as_py()
            out = []
            for k in range(ORDER + 1):
                change = np.flatnonzero(like < k)
                spans = {(0, int(change[1]) if len(change) > 1 else len(x)): first} if k else {(0, len(x)): first}
                if k:
                    spans[int(change[-1]), len(x)] = last
                for (lo, hi), name in spans.items():
                    kinds, at = np.unique(x[lo:hi], return_inverse=True)
                    sums = np.zeros((len(kinds), len(COUNTS)), np.int64)
                    np.add.at(sums, at, counts[lo:hi])
                    out += [(part, k, name[:k], int(c), *row) for c, row in zip(kinds, sums.tolist())]
            cols = list(zip(*out))
            types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, types)], ["part", "k", "context", "x", *COUNTS])

    return in_ranges(table).mapInArrow(run, "part int, k int, context string, x int, " + ", ".join(f"{c} long" for c in COUNTS))


def in_ranges(table: DataFrame) -> DataFrame:
    return table.repartition("part").sortWithinPartitions("part", "rev", "x").select("part", "rev", "x", *COUNTS)


def models(counts: np.ndarray) -> np.ndarray:
    """Counts by kind and fold (rows, kind x fold) to counts by kind and model: all folds, then all but each."""
    by = counts.reshape(-1, len(KINDS), FOLDS)
    whole = by.sum(2)
    return np.concatenate([whole[:, :, None], whole[:, :, None] - by], 2).reshape(len(counts), -1)


def evidence(table: DataFrame, ghosts: DataFrame) -> DataFrame:
    """(h, weight, d0, ...) of every window: the hash that names it, its places, and the log-likelihood difference of its
    character under the models of all folds, and of all but each fold."""
    many = len(KINDS) * (FOLDS + 1)
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("k", "int"), ("h", "long"), ("weight", "long"))}
    rows = table.select("part", "rev", "x", *COUNTS, none["k"], F.xxhash64("rev", "x").alias("h"), "weight").unionByName(
        ghosts.select("part", F.col("context").alias("rev"), F.col("x").cast("string").alias("x"), *COUNTS, "k", none["h"], none["weight"]))
    src = rows.repartition("part").sortWithinPartitions("part", F.col("k").asc_nulls_last(), "rev", "x").select("part", "rev", "x", *COUNTS, "k", "h", "weight")

    def run(batches):
        for _, t in ranges(batches):
            own = pc.is_null(t.column("k"))
            rev, x, counts = unpack(t.filter(own))
            told = t.filter(pc.invert(own))
            ghost: dict[tuple[int, str], list] = {}
            for k, context, c, *n in zip(*(told.column(c).to_pylist() for c in ("k", "rev", "x", *COUNTS))):
                ghost.setdefault((k, context), []).append((int(c), n))
            like, names = shared(rev), t.filter(own).column("rev")
            counts = models(counts)
            p = np.full((len(x), many), 1.0 / SYMBOLS)
            for k in range(ORDER + 1):
                context = np.cumsum(like < k) - 1 if k else np.zeros(len(x), np.int64)
                start = np.concatenate([[0], np.flatnonzero(np.diff(context)) + 1])
                c, symbol, n = context, x, counts
                for i in {0, len(start) - 1}:
                    if more := ghost.get((k, names[int(start[i])].as_py()[:k])):
                        # the whole of an edge context stands in the ghosts, this range's part included
                        keep = c != i
                        c = np.concatenate([c[keep], np.full(len(more), i)])
                        symbol = np.concatenate([symbol[keep], np.array([s for s, _ in more], np.int64)])
                        n = np.concatenate([n[keep], models(np.array([v for _, v in more], np.int64))])
                pairs, at = np.unique(c * SYMBOLS + symbol, return_inverse=True)
                seen = np.zeros((len(pairs), many), np.int64)
                np.add.at(seen, at, n)
                total, kinds = np.zeros((len(start), many)), np.zeros((len(start), many))
                np.add.at(total, pairs // SYMBOLS, seen)
                np.add.at(kinds, pairs // SYMBOLS, seen > 0)
                mine = np.minimum(np.searchsorted(pairs, context * SYMBOLS + x), max(len(pairs) - 1, 0))
                hit = (pairs[mine] == context * SYMBOLS + x)[:, None] if len(pairs) else np.zeros((len(x), 1), bool)
                times = np.where(hit, seen[mine], 0) if len(pairs) else np.zeros((len(x), many))
                size, kind = total[context], kinds[context]
                p = np.where(size > 0, (times + kind * p) / np.maximum(size + kind, 1), p)
            logs = np.log(p).reshape(len(x), len(KINDS), FOLDS + 1)
            diff = logs[:, 0] - logs[:, 1]
            h, weight = (t.filter(own).column(c).combine_chunks() for c in ("h", "weight"))
            yield pa.RecordBatch.from_arrays([h, weight, *(pa.array(np.ascontiguousarray(d)) for d in diff.T)],
                                             ["h", "weight", *(f"d{i}" for i in range(FOLDS + 1))])

    return src.mapInArrow(run, "h long, weight long, " + ", ".join(f"d{i} double" for i in range(FOLDS + 1)))


def positions(rows: DataFrame) -> DataFrame:
    """(row, fold, h) over rows (row, fold, kind, text): each character's window, by the hash that names it."""

    def run(batches):
        for b in batches:
            at, rev, x = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                own, chars = endings(t)
                at += [i] * len(own)
                rev += own
                x += chars
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(rev, pa.string()), pa.array(x, pa.string())],
                                             ["row", "model", "rev", "x"])

    model = F.when(F.col("kind").isNull(), 0).otherwise(F.col("fold") + 1).cast("int").alias("model")
    return rows.select("row", model, "text").mapInArrow(run, "row long, model int, rev string, x string") \
        .select("row", "model", F.xxhash64("rev", "x").alias("h"))


def ratios(rows: DataFrame) -> DataFrame:
    """(row, ratio) over rows (row, kind: allow, block or null, fold, text): log-likelihood difference per character, the
    end mark included, under the models of the rows of both kinds; of a row of a kind, without those of its own fold."""
    distinct = windows(rows).groupBy("rev", "x").agg(*(F.sum(c).alias(c) for c in (*COUNTS, "weight")))
    cut = distinct.repartitionByRange("rev", "x").withColumn("part", F.spark_partition_id())
    table = materialize(cut, "url-windows")
    partial = materialize(edges(table), "url-edges")
    whole = partial.groupBy("k", "context", "x").agg(*(F.sum(c).alias(c) for c in COUNTS))
    ghosts = partial.select("part", "k", "context").distinct().join(whole.hint("merge"), ["k", "context"])
    told = join_heavy(positions(rows), materialize(evidence(table, ghosts), "url-evidence"), "h", "weight")
    diff = F.element_at(F.array(*(F.col(f"d{i}") for i in range(FOLDS + 1))), F.col("model") + 1)
    return told.groupBy("row").agg(F.avg(diff).alias("ratio"))


def calibrate(scored: DataFrame) -> float:
    """The threshold with the least sum of the two error rates over all training URLs (kind, ratio), each scored without its
    own fold, by a histogram of ratios."""
    scored = scored.where("kind IS NOT NULL")
    top = scored.agg(F.max(F.abs("ratio"))).first()[0] or 1.0
    bins = (scored.withColumn("bin", F.floor((F.col("ratio") / top + 1) * (BINS / 2)).cast("int"))
            .groupBy("kind", "bin").count().collect())
    hist = {"allow": np.zeros(BINS + 2), "block": np.zeros(BINS + 2)}
    for r in bins:
        hist[r["kind"]][min(max(r["bin"], 0), BINS) + 1] += r["count"]
    wrong = np.cumsum(hist["allow"]) / hist["allow"].sum() + 1 - np.cumsum(hist["block"]) / hist["block"].sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    edge = (best[0] + best[-1]) / 2  # the middle of the widest equal choice
    return top * (edge / (BINS / 2) - 1)


def judge(pages: DataFrame, rules: dict[str, str] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and ratio (null where a rule decides) of every row."""
    src = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    parts = src.select("*", host(F.col("text")).alias("host"), path(F.col("text")).alias("path"))
    ruled = parts.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for r, v in rules.items():
        by_rule = F.when(F.col("rule") == r, F.lit(v)).otherwise(by_rule)
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    told = materialize(ruled.withColumn("kind", by_rule).select("*", fold), "url-rules")
    keep = [F.col(c) for c in ("page_id", "host", "path", "rule")]
    if told.where("kind IS NOT NULL").select("kind").distinct().count() < 2:
        return told.select(*keep, F.coalesce("kind", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    scored = materialize(told.join(ratios(told.select("row", "kind", "fold", "text")), "row"), "url-scored")
    verdict = F.when(F.col("ratio") >= calibrate(scored), "allow").otherwise("block")
    return scored.select(*keep, F.coalesce("kind", verdict).alias("verdict"), F.when(F.col("rule").isNull(), F.col("ratio")).alias("ratio"))
