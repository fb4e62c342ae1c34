"""SimHash near-duplicates with pigeonring filtering.

The 64 bits are cut into ``m`` segments on a ring, more than the ``k`` bits that
may differ.  By the pigeonring principle two fingerprints within ``k`` bits have a
segment from which every chain of ``l`` consecutive segments differs in at most
``l * k / m`` bits: none in the first, and, by the first ``l`` whose budget is
below ``l - 1``, another whole segment of the chain is equal too.  So fingerprints
are bucketed by (start, equal later segment), which finds every pair; inside a
bucket the chain budgets are tried segment by segment, and only what survives all
of them gets the full Hamming check.

Equal fingerprints are one node.  A bucket yields a spanning forest of its links
rather than all its pairs, so a group of thousands of near copies costs as many
rows as it has members; a bucket beyond ``TILE`` members is dealt as pairs of
tiles to several tasks, so no group meets in one task and none is cut short.

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; a null doc_id takes part, but names a component only if every id in it is
null; repeated rows are copies; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import components

SHINGLE, MAX_BITS, SEGMENTS, SEED = 4, 4, 6, 42
#: Members of a bucket that one task compares at most (a tile; a task holds two).
TILE = 4096


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Majority vote per bit over the XXH64 of the lower-cased (A-Z) k-word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[k - 1:] - 1).tolist())], "<u8")
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 15):
        votes += np.unpackbits(h[lo:lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * votes > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, keep: tuple[str, ...], text: str = "text", k: int = SHINGLE) -> DataFrame:
    """``keep`` columns and fp (the fingerprint as a signed long) of every row."""
    src = df.select(*keep, text)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*keep, "fp"])

    types = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "fp long"]))


class Ring:
    """Segments, chain masks and budgets for ``max_bits`` differing bits."""

    def __init__(self, max_bits: int = MAX_BITS, segments: int = SEGMENTS):
        if not (0 <= max_bits < segments <= 64 and segments > 1):
            raise ValueError("need 0 <= max_bits < segments, and 2 to 64 segments")
        self.k, self.m = max_bits, segments
        cuts = [64 * i // segments for i in range(segments + 1)]
        self.low, self.width = cuts[:-1], np.diff(cuts).tolist()
        self.mask = [((1 << w) - 1) << a for a, w in zip(self.low, self.width)]
        self.budget = [n * max_bits // segments for n in range(segments + 1)]
        #: chain[i][n - 1]: bits of the n segments from i on
        self.chain = [[sum(self.mask[(i + j) % segments] for j in range(n)) for n in range(1, segments + 1)]
                      for i in range(segments)]
        # after the first segment, one of the next ``reach`` is equal as well (0: that can't be told)
        self.reach = next((n - 1 for n in range(2, segments + 1) if self.budget[n] < n - 1), 0)

    def tables(self) -> list[tuple[int, int]]:
        return [(i, (i + d) % self.m) for i in range(self.m) for d in range(1, self.reach + 1)] or [(i, i) for i in range(self.m)]

    def keys(self, fp: Column) -> Column:
        """One bucket key per table: its number above the bits of its two segments."""
        def part(s: int) -> Column:
            return F.shiftrightunsigned(fp, self.low[s]).bitwiseAND(F.lit((1 << self.width[s]) - 1))
        return F.array(*(F.shiftleft(F.lit(t).cast("long"), 48).bitwiseOR(
            F.shiftleft(part(i), self.width[j]) if i != j else F.lit(0)).bitwiseOR(part(j)) for t, (i, j) in enumerate(self.tables())))

    def near(self, x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        """Positions of the differences ``x`` that stay in every chain budget from ``start`` and in the whole one."""
        alive = np.arange(len(x))
        chain = np.array(self.chain, np.uint64)
        for n in range(1, self.m):
            masks = chain[start, n - 1] if np.isscalar(start) else chain[start[alive], n - 1]
            alive = alive[np.bitwise_count(x[alive] & masks) <= self.budget[n]]
        return alive[np.bitwise_count(x[alive]) <= self.k]

    def forest(self, fps: np.ndarray, start: int) -> list[tuple[int, int]]:
        """Spanning forest of the links among ``fps`` that are viable from ``start``, as positions."""
        out, left = [], np.arange(len(fps))
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                p = todo.pop()
                hit = self.near(fps[left] ^ fps[p], start)
                if len(hit):
                    found = left[hit]
                    out += [(int(p), int(q)) for q in found]
                    todo += found.tolist()
                    left = np.delete(left, hit)
        return out


def links(nodes: DataFrame, ring: Ring, tile: int = TILE) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``nodes.fp`` that connect all that are near."""
    keyed = nodes.select("fp", F.explode(ring.keys(F.col("fp"))).alias("key"))
    sizes = materialize(keyed.groupBy("key").count().where("count > 1"), "simhash-sizes")
    dealt = (keyed.join(sizes, "key")
             .withColumn("tiles", F.ceil(F.col("count") / tile).cast("int"))
             .withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
             .withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    groups = dealt.groupBy("key", F.least("t", "u").alias("ta"), F.greatest("t", "u").alias("tb")).agg(
        F.collect_list("fp").alias("fps")).select("key", "fps")
    starts = np.array([i for i, _ in ring.tables()])

    def compare(batches):
        for b in batches:
            lists = b.column(1)
            fps = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.cumsum(n) - n
            start = starts[b.column(0).to_numpy() >> 48]
            two = np.flatnonzero(n == 2)
            hit = two[ring.near(fps[at[two]] ^ fps[at[two] + 1], start[two])]
            a, c = [fps[at[hit]]], [fps[at[hit] + 1]]
            for g in np.flatnonzero(n > 2).tolist():
                own = fps[at[g]:at[g] + n[g]]
                edges = np.array(ring.forest(own, int(start[g])), np.int64).reshape(-1, 2)
                a.append(own[edges[:, 0]])
                c.append(own[edges[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, c)], ["a", "b"])

    return groups.mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE,
                    max_bits: int = MAX_BITS, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """doc_id, ``keep``, root, fingerprint (hex) and component_id of every row.

    component_id is the smallest doc_id of the row's component, root its smallest
    fingerprint (as a signed long).
    """
    ring = Ring(max_bits, segments)
    docs = materialize(fingerprints(df.select(F.col(doc_id).alias("doc_id"), *keep, text), ("doc_id", *keep), text, k), "simhash-docs")
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    roots = components(links(nodes, ring, tile))
    linked = materialize(nodes.join(roots, nodes.fp == roots.node).select("fp", "root", "id"), "simhash-linked")
    first = materialize(linked.groupBy("root").agg(F.min("id").alias("cid")), "simhash-first")
    named = linked.join(first, "root").select("fp", "root", "cid")
    ids = materialize(nodes.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("cid", "id").alias("component_id")), "simhash-ids")
    return docs.join(ids, "fp").select("doc_id", *keep, "root", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                       "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with its own columns, that are the first of their component."""
    # a row is known by its id and text; rows that agree in both are copies, of which one stays
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    src = df.select(whole, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    marks = near_duplicates(src, ("th",), **options)
    rank = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("th").alias("t"))
    first = materialize(marks.groupBy("root").agg(F.min(rank).alias("r")).select(
        F.col("r.d").alias("id"), F.col("r.t").alias("t")), "simhash-kept")
    kept = src.select("row", "doc_id", "th").join(first.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("t")), "left_semi")
    one = Window.partitionBy("doc_id", "th").orderBy(F.xxhash64(*(F.col(f"row.`{c}`") for c, t in df.dtypes if not t.startswith("map"))))
    return kept.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")
