"""Line dedup by pairwise alignment: blocks that an earlier document has leave the later one.

A document is a sequence of words.  A *window* is ``MIN_WORDS`` words in a row.

1. Anchors: the least hash of a window's ``gram_words`` word grams depends on the window
   alone, so equal windows agree on it.  Neighbouring windows with the same gram make one
   run, a row with the gram, the hash of the run's words and its place.  Grams that one
   document alone has are done with.
2. Hits: a run that an earlier document has word for word is one.  Of every other run the
   first holder is left; where a gram has several different runs, the windows of these are
   compared one by one, with their texts at hand.  Every hit names the first holder (never
   all holders, so a passage that a third of all documents share makes one pair per document).
3. Alignment: the hits of a pair that touch on one diagonal are merged, and patience
   picks the blocks that stand in the same order in both documents.  What crosses the
   alignment, because it was moved or repeated, counts as it is.
4. Gaps: between two aligned blocks the two documents' words are compared with each other,
   again by patience, now over their grams of ``gram_words`` words; common blocks of so many
   words and more are aligned too.  Only these stretches of the earlier document travel,
   in segments that all its partners share.
5. All aligned words, with the blanks that follow them, are deleted from the later document.

A document whose whole text an earlier one has needs none of this: all its words go, and as a holder it never is the first.
That is known of the ``KNOWN`` texts that most rows have; a copy of any other text takes the steps like all documents.
Where a step needs the texts of some documents, a sieve of these keeps the other texts out of the shuffle.

So a word is deleted if it lies in a window that an earlier document has, wherever lines
and sentences end, or in a shorter block that lies between two aligned ones in both.
A hash that a large share of all rows has is joined without a shuffle of its rows
(``join_heavy``).

Edge cases: null and empty texts have no words and stay as they are; documents
under MIN_WORDS words are never touched; rows that share an id are one document
(not compared with each other, repeated rows get the same result), rows without
an id come last and count as one document as well; an empty table gives no rows;
further columns, whatever their names, are carried along as one struct (``doc_id`` and ``text`` must differ).  Ids are integers.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import free_names, join_heavy, materialize, word_count
from .words import Stretches, chunks, hashes, words_of

MIN_WORDS = 20
NO_ID = (1 << 63) - 1
#: Words of a segment in which an earlier document's words travel.
SEGMENT = 64
#: Classes of grams in the sieve (8 MB).
SIEVE = 1 << 26
#: Most texts of which every task knows the first document (4 MB).
KNOWN = 1 << 18


def gram_words(least: int) -> int:
    """Words of an anchor gram, and of the shortest block that counts between two aligned ones."""
    return max(1, 2 * least // 5)


def runs(x: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their least gram, of documents laid end to end: document, first window's word,
    windows, gram, hash of all words."""
    last = len(x) - least + 1
    if last <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    parts, k = Stretches(x), gram_words(least)
    low, span, want = parts.at(np.arange(len(x) - k + 1), k), 1, least - k + 1
    while span < want:
        step = min(span, want - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = doc[:last] == doc[least - 1:]
    doc = doc[:last]
    fresh = np.ones(last + 1, bool)
    fresh[1:-1] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1] | ~inside[1:]
    begin = np.flatnonzero(fresh[:-1] & inside)
    n = np.flatnonzero(fresh[1:] & inside) - begin + 1
    first = np.cumsum(sizes) - sizes
    return doc[begin], begin - first[doc[begin]], n, low[begin], parts.at(begin, n + least - 1)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Firsts:
    """The first document of texts that several documents have."""

    def __init__(self, docs: DataFrame):
        many = docs.groupBy("t").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.count("*").alias("n")).where("a < z")
        top = many.orderBy(F.col("n").desc(), "t").limit(KNOWN).select("t", "a").toArrow()
        t, a = (top.column(c).to_numpy() for c in ("t", "a"))
        order = np.argsort(t)
        self.t, self.a = t[order], a[order]

    def copies(self, d: pa.Array, t: pa.Array) -> np.ndarray:
        """Which rows have the text of an earlier document."""
        d, t = (c.to_numpy(zero_copy_only=False) for c in (d, t))
        if not len(self.t):
            return np.zeros(len(t), bool)
        at = np.minimum(np.searchsorted(self.t, t), len(self.t) - 1)
        return (self.t[at] == t) & (self.a[at] < d)

    def others(self, b: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of a batch (d, t, text) that are no copies."""
        return b.filter(pa.array(~self.copies(b.column(0), b.column(1))))


def gram_rows(docs: DataFrame, least: int, firsts: Firsts) -> DataFrame:
    """(g, d, runs): the least grams of the windows of ``docs`` (d, t, text), once a document, and the runs that have them."""

    def run(batches):
        for b in map(firsts.others, batches):
            for first, sizes, x in chunks(b.column(2)):
                doc, _, _, gram, _ = runs(x, sizes, least)
                at = np.lexsort((gram, doc))
                doc, gram = doc[at], gram[at]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
                at = np.flatnonzero(fresh)
                yield pa.RecordBatch.from_arrays([signed(gram[at]), b.column(0).take(pa.array(doc[at] + first)),
                                                  pa.array(np.diff(at, append=len(doc)).astype(np.int32))], ["g", "d", "runs"])

    return docs.select("d", "t", "text").mapInArrow(run, "g long, d long, runs int")


def sieve(grams: DataFrame) -> np.ndarray:
    """One bit for each of ``SIEVE`` classes of grams (or other hashes): whether a gram of the class is among ``grams``.

    Its size is fixed.  What passes it is joined with the grams all the same, so a crowded sieve costs rows and changes none.
    """
    place = F.col("g").bitwiseAND(F.lit(SIEVE - 1)) + 1
    bits = grams.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(SIEVE // 8, np.uint8)
    for r in bits.collect():
        out[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def passes(wanted: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which of the grams, as longs, the sieve lets pass."""
    place = g & (SIEVE - 1)
    return ((wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def documents(rows: DataFrame) -> np.ndarray:
    """The sieve of the documents (d, t) among ``rows``."""
    return sieve(rows.select(F.xxhash64("d", "t").alias("g")))


def among(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``docs`` (d, t) that may be among ``rows`` (d, t), and few others: a join needs to shuffle these only."""
    wanted = documents(rows)

    @F.arrow_udf("boolean")
    def some(g: pa.Array) -> pa.Array:
        return pa.array(passes(wanted, g.to_numpy(zero_copy_only=False)))

    return docs.where(some(F.xxhash64("d", "t")))


def run_rows(docs: DataFrame, least: int, wanted: np.ndarray, firsts: Firsts) -> DataFrame:
    """(g, h, d, t, pos, n) of every run of ``docs`` (d, t, text) whose gram passes the sieve: its gram, the hash of its
    words, its document and the hash of its text, place and number of words."""

    def run(batches):
        for b in map(firsts.others, batches):
            for first, sizes, x in chunks(b.column(2)):
                doc, pos, n, gram, whole = runs(x, sizes, least)
                some = np.flatnonzero(passes(wanted, gram.view(np.int64)))
                at = pa.array(doc[some] + first)
                yield pa.RecordBatch.from_arrays(
                    [signed(gram[some]), signed(whole[some]), b.column(0).take(at), b.column(1).take(at), pa.array(pos[some].astype(np.int32)),
                     pa.array((n[some] + least - 1).astype(np.int32))], ["g", "h", "d", "t", "pos", "n"])

    return docs.select("d", "t", "text").mapInArrow(run, "g long, h long, d long, t long, pos int, n int")


def window_rows(docs: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """(h, d, t, pos, n) of every window in the runs ``places`` (d, t, pos, n)."""
    lists = materialize(places.groupBy("d", "t").agg(F.collect_list(F.struct("pos", "n")).alias("runs")), "lines-places")
    src = among(docs, lists).join(lists.toDF("d1", "t1", "runs").hint("merge"), (F.col("d") == F.col("d1")) & (F.col("t") == F.col("t1"))) \
        .select("d", "t", "text", "runs")

    def run(batches):
        for b in batches:
            flat = b.column(3).flatten()
            pos, n = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in flat.flatten())
            ends = np.cumsum(b.column(3).value_lengths().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(b.num_rows), np.diff(ends, prepend=0))
            windows = n - least + 1
            row = np.repeat(row, windows)
            at = np.repeat(pos - np.cumsum(windows) + windows, windows) + np.arange(len(row))
            for first, sizes, x in chunks(b.column(2)):
                lo, hi = np.searchsorted(row, [first, first + len(sizes)])
                own = np.unique((row[lo:hi] << 40) + at[lo:hi])
                r, p = own >> 40, own & (1 << 40) - 1
                starts = np.cumsum(sizes) - sizes
                h = Stretches(x).at(starts[r - first] + p, least)
                r = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [signed(h), b.column(0).take(r), b.column(1).take(r), pa.array(p.astype(np.int32)),
                     pa.array(np.full(len(p), least, np.int32))], ["h", "d", "t", "pos", "n"])

    return src.mapInArrow(run, "h long, d long, t long, pos int, n int")


def holders(rows: DataFrame, *keep: str) -> DataFrame:
    """The first document (a, ta) that holds each hash, its place there (other), the last document (z), and the rows (weight)."""
    return (rows.groupBy("h", *keep).agg(F.min(F.struct("d", "t", "pos")).alias("one"), F.max("d").alias("z"), F.count("*").alias("weight"))
            .select("h", *keep, F.col("one.d").alias("a"), F.col("one.t").alias("ta"), F.col("one.pos").alias("other"), "z", "weight"))


def later(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Hits: the rows whose hash an earlier document has."""
    known = first.where("a < z").select("h", "a", "ta", "other", "weight")
    return join_heavy(rows.select("h", "d", "t", "pos", "n"), known, "h", "weight", rows.count()).where("d > a") \
        .select("d", "t", "a", "ta", "pos", "other", "n")


def patience(pairs: list[tuple[int, int]]) -> list[int]:
    """Indexes of a longest sequence of (own, other) positions that rises in both; ``pairs`` is sorted."""
    tails, at, before = [], [], [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        if k:
            before[i] = at[k - 1]
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def merge(doc: np.ndarray, a: np.ndarray, ta: np.ndarray, pos: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The hits with those that touch on one diagonal of a pair made one, by document and partner."""
    order = np.lexsort((pos, other - pos, ta, a, doc))
    doc, a, ta, pos, other, n = (x[order].astype(np.int64) for x in (doc, a, ta, pos, other, n))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (np.diff(doc) != 0) | (a[1:] != a[:-1]) | (ta[1:] != ta[:-1]) | (np.diff(other - pos) != 0)
    group = np.cumsum(fresh) << 32
    reach = np.maximum.accumulate(group + pos + n) - group
    fresh[1:] |= pos[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    stop = reach[np.append(at[1:], len(doc)) - 1] if len(at) else reach
    return doc[at], a[at], ta[at], pos[at], other[at], stop - pos[at]


def align(found: list[tuple[int, int, int]], gap: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """From the merged hits (own, other, length) of one pair: the own ranges (first, last + 1) that the other document
    has, and the gaps (own range, other's range) of ``gap`` words and more between consecutive aligned blocks."""
    row = sorted(set(found))
    # own positions must rise as well: of several hits at one place the longest speaks
    best: dict[int, tuple[int, int, int]] = {}
    for p in row:
        if p[0] not in best or p[2] > best[p[0]][2]:
            best[p[0]] = p
    row = list(best.values())
    gaps = []
    chosen = [row[i] for i in patience([(x, y) for x, y, _ in row])]
    for (x, y, n), (x2, y2, _) in zip(chosen, chosen[1:]):
        if x2 - x - n >= gap and y2 - y - n >= gap:
            gaps.append((x + n, x2, y + n, y2))
    return [(x, x + n) for x, _, n in found], gaps


def gap_blocks(x: np.ndarray, y: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Own ranges of the blocks of ``k`` words and more that patience aligns between the word hashes of a gap."""
    out, todo = [], [(0, len(x), 0, len(y))]
    if len(x) < k or len(y) < k:
        return out
    gx, gy = (Stretches(v).at(np.arange(len(v) - k + 1), k) for v in (x, y))
    while todo:
        a, b, c, d = todo.pop()
        if b - a < k or d - c < k:
            continue
        (u, at, n), (v, other, m) = (np.unique(g, return_index=True, return_counts=True) for g in (gx[a:b - k + 1], gy[c:d - k + 1]))
        common, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        once = (n[i] == 1) & (m[j] == 1)
        pairs = sorted(zip((at[i[once]] + a).tolist(), (other[j[once]] + c).tolist()))
        ends = [(a, c)]
        for p, q in [pairs[i] for i in patience(pairs)]:
            lo, hi = ends[-1]
            if p < lo or q < hi:
                continue  # inside the block before
            s = p, q
            while s[0] > lo and s[1] > hi and x[s[0] - 1] == y[s[1] - 1]:
                s = s[0] - 1, s[1] - 1
            e = p + k, q + k
            while e[0] < b and e[1] < d and x[e[0]] == y[e[1]]:
                e = e[0] + 1, e[1] + 1
            out.append((s[0], e[0]))
            todo.append((lo, s[0], hi, s[1]))
            ends.append(e)
        if len(ends) > 1:
            todo.append((ends[-1][0], b, ends[-1][1], d))
    return out


def ranges(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of the blocks as disjoint ranges, in order."""
    out: list[list[int]] = []
    for a, z in sorted(blocks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def aligned(hits: DataFrame, least: int) -> DataFrame:
    """(d, t, cuts, gaps): the words of each document that first holders have (first, last + 1, flat), and the gaps to compare."""
    per_doc = hits.groupBy("d", "t").agg(F.collect_list(F.struct("a", "ta", "pos", "other", "n")).alias("hits"))
    k = gram_words(least)
    gap_type = pa.list_(pa.struct([("a", pa.int64()), ("ta", pa.int64()), *((c, pa.int32()) for c in ("i", "j", "from", "to"))]))

    def run(batches):
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            fields = (c.to_numpy(zero_copy_only=False) for c in b.column(2).flatten().flatten())
            doc, a, ta, pos, other, n = merge(np.repeat(np.arange(len(sizes)), sizes), *fields)
            own: list[list[tuple[int, int]]] = [[] for _ in sizes]
            gaps: list[list[tuple]] = [[] for _ in sizes]
            at = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (a[1:] != a[:-1]) | (ta[1:] != ta[:-1]))) if len(doc) else doc
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(doc)]):
                i = doc[lo]
                if hi == lo + 1:
                    own[i].append((int(pos[lo]), int(pos[lo] + n[lo])))
                    continue
                blocks, between = align(list(zip(pos[lo:hi].tolist(), other[lo:hi].tolist(), n[lo:hi].tolist())), k)
                own[i] += blocks
                gaps[i] += [(int(a[lo]), int(ta[lo]), *g) for g in between]
            cuts = [ranges(o) for o in own]
            # a gap that other partners' blocks cover has nothing left to find
            gaps = [[dict(zip(("a", "ta", "i", "j", "from", "to"), g)) for g in gs if not any(x <= g[2] and g[3] <= z for x, z in c)]
                    for gs, c in zip(gaps, cuts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[x for r in c for x in r] for c in cuts], pa.list_(pa.int32())),
                                              pa.array(gaps, gap_type)], ["d", "t", "cuts", "gaps"])

    return per_doc.mapInArrow(run, "d long, t long, cuts array<int>, gaps array<struct<a long, ta long, i int, j int, from int, to int>>")


def segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, weight, words) of the ``wanted`` (key: a, ta and seg; weight): the word hashes of an earlier document's segments."""
    lists = materialize(wanted.groupBy("key.a", "key.ta").agg(F.collect_list(F.struct("key.seg", "weight")).alias("segs")), "lines-wanted")
    src = among(docs, lists.toDF("d", "t", "segs")).join(lists.hint("merge"), (F.col("d") == F.col("a")) & (F.col("t") == F.col("ta"))) \
        .select("a", "ta", "text", "segs").dropDuplicates(["a", "ta"])

    def run(batches):
        for b in batches:
            for first, sizes, x in chunks(b.column(2)):
                starts, out = np.cumsum(sizes) - sizes, []
                for i, n in enumerate(sizes.tolist()):
                    own = x[starts[i]:starts[i] + n]
                    for s in b.column(3)[first + i].as_py():
                        out.append((i + first, s["seg"], s["weight"], own[s["seg"] * SEGMENT:(s["seg"] + 1) * SEGMENT].tobytes()))
                row, seg, weight, words = zip(*out) if out else ((),) * 4
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(seg, pa.int32()),
                                                  pa.array(weight, pa.int64()), pa.array(words, pa.binary())], ["a", "ta", "seg", "weight", "words"])

    return src.mapInArrow(run, "a long, ta long, seg int, weight long, words binary") \
        .select(F.struct("a", "ta", "seg").alias("key"), "weight", "words")


def gap_words(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(d, t, parts): for each document with gaps, the stretches of other documents to compare them with, in segments."""
    asked = blocks.where(F.size("gaps") > 0).select("d", "t", F.posexplode("gaps").alias("no", "g")).select(
        "d", "t", "no", "g.*", F.explode(F.sequence(F.floor(F.col("g.from") / SEGMENT).cast("int"), F.floor((F.col("g.to") - 1) / SEGMENT).cast("int"))).alias("seg"))
    asked = materialize(asked.select(F.struct("a", "ta", "seg").alias("key"), "d", "t", "no", "i", "j", "from", "to", "seg"), "lines-gaps")
    wanted = asked.groupBy("key").agg(F.count("*").alias("weight"))
    found = materialize(segments(docs, wanted), "lines-segments")
    return join_heavy(asked, found, "key", "weight", asked.count()).groupBy("d", "t").agg(
        F.collect_list(F.struct("no", "seg", "i", "j", "from", "to", "words")).alias("parts"))


def copied_blocks(docs: DataFrame, least: int, firsts: Firsts) -> DataFrame:
    """(d, t, cuts, parts) of each of ``docs`` (d, t, text) that repeats earlier ones and is no known copy of one: the words to delete (first, last + 1,
    flat), and what its gaps are to be compared with."""
    shared = materialize(gram_rows(docs, least, firsts).groupBy("g").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.sum("runs").alias("weight"))
                         .where("a < z").select("g", "weight"), "lines-grams")
    rows = materialize(run_rows(docs, least, sieve(shared), firsts), "lines-runs")
    rows = materialize(join_heavy(rows, shared, "g", "weight", rows.count()).drop("weight"), "lines-candidates")
    first = materialize(holders(rows, "g"), "lines-holders")
    # grams whose runs differ: only there a window can be shared without its run
    mixed = first.groupBy("g").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least < most").select("g")
    some = materialize(first.join(mixed, "g").select("h", "a", "weight"), "lines-mixed")
    places = join_heavy(rows, some, "h", "weight", rows.count()).where("d = a").select("d", "t", "pos", "n")
    windows = materialize(window_rows(docs, places, least), "lines-windows")
    whole = materialize(holders(windows).where("a < z"), "lines-windows-held")
    blocks = materialize(aligned(later(rows, first).unionByName(later(windows, whole)), least), "lines-blocks")
    parts = gap_words(docs, blocks).toDF("d2", "t2", "parts")
    return blocks.drop("gaps").join(parts.hint("merge"), (F.col("d") == F.col("d2")) & (F.col("t") == F.col("t2")), "left") \
        .select("d", "t", "cuts", "parts")


def cut(raw: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]], int]:
    """The UTF-8 text without the words cut, the deleted spans in code points, and the words deleted."""
    data = np.frombuffer(raw, np.uint8)
    starts = np.append(words_of(data, np.array([0, len(data)]))[0], len(data))
    starts[0] = 0
    spans = [(int(starts[a]), int(starts[z])) for a, z in cuts]
    kept, last = [], 0
    for a, z in spans:
        kept.append(raw[last:a])
        last = z
    if not raw.isascii():
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        spans = [(int(before[a]), int(before[z])) for a, z in spans]
    return b"".join([*kept, raw[last:]]), spans, sum(z - a for a, z in cuts)


def all_cuts(raw: bytes, cuts: list[int], parts: list[dict] | None, k: int) -> list[tuple[int, int]]:
    """The cuts and what the gaps of the text add to them."""
    blocks = list(zip(cuts[::2], cuts[1::2]))
    if parts:
        data = np.frombuffer(raw, np.uint8)
        own = hashes(data, np.array([0, len(data)]))[0]
        gaps: dict[int, list[dict]] = {}
        for p in parts:
            gaps.setdefault(p["no"], []).append(p)
        for g in gaps.values():
            g.sort(key=lambda p: p["seg"])
            lead = g[0]["seg"] * SEGMENT
            other = np.frombuffer(b"".join(p["words"] for p in g), np.uint64)[g[0]["from"] - lead:g[0]["to"] - lead]
            i, j = g[0]["i"], g[0]["j"]
            blocks += [(a + i, z + i) for a, z in gap_blocks(own[i:j], other, k)]
    return ranges(blocks)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(row, text, spans, removed_words, removed_chars) of every row of ``docs``: its other columns as a struct, its text without
    the blocks earlier documents have, and what was deleted (code points, "start:end" joined by commas)."""
    # one pair of columns knows a row's document and text
    src = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row"), F.col(text).alias("text"),
                      F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    k = gram_words(least)
    firsts = Firsts(src.select("d", "t"))
    blocks = materialize(copied_blocks(src.select("d", "t", "text"), least, firsts), "lines-cuts")
    wanted = documents(blocks)

    @F.arrow_udf("int")
    def way(g: pa.Array, d: pa.Array, t: pa.Array) -> pa.Array:
        """2: a copy, 1: may have cuts, 0: has none."""
        return pa.array(np.where(firsts.copies(d, t), 2, passes(wanted, g.to_numpy(zero_copy_only=False))).astype(np.int32))

    src = src.withColumn("way", way(F.xxhash64("d", "t"), "d", "t"))
    words = F.when(F.col("way") == 2, word_count(F.col("text"))).otherwise(F.lit(0))
    chars = F.char_length("text").cast("long")
    whole = src.where("way <> 1").withColumn("words", words).withColumn("gone", F.col("words") >= least).select(
        "row", F.when(F.col("gone"), F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("gone"), F.concat(F.lit("0:"), chars)).otherwise(F.lit("")).alias("spans"),
        F.when(F.col("gone"), F.col("words")).otherwise(F.lit(0)).cast("long").alias("removed_words"),
        F.when(F.col("gone"), chars).otherwise(F.lit(0)).cast("long").alias("removed_chars"))
    # always a shuffle join: what is cut grows with the documents, so it is never sent to every task
    joined = src.where("way = 1").join(blocks.toDF("d1", "t1", "cuts", "parts").hint("merge"), (F.col("d") == F.col("d1")) & (F.col("t") == F.col("t1")), "left") \
        .select("row", "text", "cuts", "parts")

    def run(batches):
        for b in batches:
            n, hit = b.num_rows, b.column(2).is_valid()
            mask = hit.to_numpy(zero_copy_only=False)
            spans, words, chars, new = [""] * n, np.zeros(n, np.int64), np.zeros(n, np.int64), []
            some = b.select([1, 2, 3]).filter(hit)
            for i, raw, c, parts in zip(np.flatnonzero(mask).tolist(), some.column(0).cast(pa.binary()).to_pylist(),
                                        some.column(1).to_pylist(), some.column(2).to_pylist()):
                short, gone, words[i] = cut(raw, all_cuts(raw, c, parts, k))
                spans[i], chars[i] = ",".join(f"{a}:{z}" for a, z in gone), sum(z - a for a, z in gone)
                new.append(short)
            texts = b.column(1).cast(pa.string())
            if new:
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array(spans, pa.string()), pa.array(words), pa.array(chars)],
                                             ["row", "text", "spans", "removed_words", "removed_chars"])

    return whole.unionByName(joined.mapInArrow(run, StructType([src.schema["row"], *(StructField(c, t) for c, t in (
        ("text", StringType()), ("spans", StringType()), ("removed_words", LongType()), ("removed_chars", LongType())))])))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs``, its text without the blocks earlier documents have, and behind its own columns
    spans, removed_words and removed_chars (with "_" before them where ``docs`` has such a column)."""
    own = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    names = free_names(docs.columns, "spans", "removed_words", "removed_chars")
    return dedup(docs, doc_id, text, least).select(*own, *(F.col(c).alias(n) for c, n in zip(("spans", "removed_words", "removed_chars"), names)))
