"""N-gram Jaccard join as a metric-space join: who is connected by links of similarity 0.8 and more.

The Jaccard distance of two documents' sets of word shingles is a metric.  The join

1. puts equal sets together as one node;
2. chooses pivots: nodes are grouped by several min-hashes, and a node that is among the
   first ``PIVOTS`` of all its groups is a pivot.  Every node is compared with the pivots
   of its groups, and one that is none goes to the Voronoi region of the nearest, if that is
   within the region radius; else it is a pivot itself.  The distance to the pivot is kept;
3. finds the regions that may hold a link: two sets within the distance share a token of
   their prefixes (rarest shingles first) with enough tokens left behind it, so regions
   are paired by the prefix tokens of their members.  A region states a token once,
   however many members have it, so a group of a thousand near copies makes no million pairs;
4. computes the pivots' distance of each pair of regions.  A distance within the bound is
   a link.  Otherwise, by the triangle inequality, a link between a member x of one and a
   member y of the other needs  d(p, q) <= d(x, p) + bound + d(y, q):  members outside this
   window are done with, the others, the boundary, are replicated into the next round;
5. joins the boundary again by the same steps with a smaller radius, down to zero, where
   every node is its own region; there the pivots' distance is the pair's own.

Pairs of nodes meet only if their signatures allow it.  A signature says of each of ``BITS`` classes of shingles
whether the set has an odd number of them; where two signatures differ, a shingle is in one set alone, so the bits
that differ bound the distance from below, and what they rule out need not be computed.

Nodes that links connect already need no further comparison, so only pairs of different
components are looked at.  Every link that could connect two components is
computed exactly, from whole sets.  The order of the prefix tokens comes from a count of
all shingles in ``COUNTERS`` cells, which is what is sent to every task (one byte a cell,
whatever the corpus); any order gives the same result, this one keeps common shingles
out of the prefixes.

Shingles are known by 64-bit hashes.  Equal sets are recognised by 64 further bits and
checked by another 64; if two sets ever agree in the first only, hashing starts again with
another seed.

Edge cases: null and blank texts have no shingles, ``n_shingles`` 0 and are linked with
nothing; a text shorter than a shingle is one shingle; rows are documents, so rows that
share an id are compared too; a row without an id takes part and names no component (a
component of such rows has a null one); an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_heavy, materialize, small
from .components import components
from .words import Stretches, chunks

WORDS, LEAST = 5, Fraction(4, 5)
#: Min-hash groupings that choose pivots, pivots of a group, and the region radius of each round; the last must be 0.
GROUPINGS, PIVOTS, RADII = 3, 8, (0.2, 0.05, 0.0)
#: Cells that count shingles, and cells in a block of them.
COUNTERS, BLOCK = 1 << 20, 1 << 12
#: Classes of shingles in a signature, a multiple of 64.
BITS = 512
SLACK = 1e-9


def shingle_sets(texts: pa.Array, k: int):
    """(first row, sets) of runs of rows: the sorted distinct shingle hashes of each."""
    for first, sizes, x in chunks(texts, fold=True):
        parts = Stretches(x)
        whole = parts.at(np.arange(len(x) - k + 1), k) if len(x) >= k else np.zeros(0, np.uint64)
        out = []
        for n, z in zip(sizes.tolist(), np.cumsum(sizes).tolist()):
            if n >= k:
                out.append(np.unique(whole[z - n:z - k + 1]))
            else:
                out.append(parts.at(np.array([z - n]), n) if n else np.zeros(0, np.uint64))
        yield first, out


def scatter(x: np.ndarray, j: int) -> np.ndarray:
    """The j-th reordering of the hashes."""
    x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signed(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def signatures(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The signatures, as rows of longs, of sets of n hashes each that lie end to end."""
    place = ((flat >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64) + np.repeat(np.arange(len(n)) * BITS, n)
    odd = (np.bincount(place, minlength=len(n) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(len(n), BITS // 64)


def may_lie_within(away: Column, n: tuple[Column, Column], sig: tuple[Column, Column]) -> Column:
    """Whether two sets of sizes ``n`` can be ``away`` or less from each other, as far as their signatures tell.

    Sets that differ in k shingles are 2k / (n + n + k) apart, which rises with k, and k bits that differ are k shingles or more.
    """
    differ = sum((F.bit_count(sig[0][i].bitwiseXOR(sig[1][i])) for i in range(BITS // 64)), F.lit(0))
    return 2 * differ <= (away + SLACK) * (n[0] + n[1] + differ)


class Join:
    """The steps over one table of documents (id, th, text); ``th`` is a hash of the text that finds a row again."""

    def __init__(self, docs: DataFrame, words: int, least: Fraction, groupings: int, radii: tuple, seed: int = 0):
        if not radii or radii[-1] != 0 or any(not 0 <= r <= float(1 - least) + SLACK for r in radii):
            raise ValueError("radii must lie between 0 and the bound and end with 0")
        self.docs, self.k, self.least, self.groupings, self.radii, self.seed = docs, words, least, groupings, radii, seed
        self.bound = float(1 - least)

    # -- sets -----------------------------------------------------------------------------

    def describe(self) -> DataFrame:
        """(id, th, node, again, n, keys, sig) of every row, and the counts of the shingles' cells (block, counts)."""
        k, seed, keys = self.k, self.seed, max(1, (len(self.radii) - 1) * self.groupings)
        schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("again", pa.int64()), ("n", pa.int32()),
                            ("keys", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64())), ("block", pa.int32()), ("counts", pa.binary())])

        def run(batches):
            counts = np.zeros(COUNTERS, np.int64)
            for b in batches:
                for lo, sets in shingle_sets(b.column(2), k):
                    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                    np.add(counts, np.bincount((flat & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS), out=counts)
                    n = np.array([len(s) for s in sets])
                    some = np.flatnonzero(n)
                    starts = (np.cumsum(n) - n)[some]
                    low = np.zeros((len(sets), keys), np.uint64)
                    for j in range(keys if len(some) else 0):
                        low[some, j] = np.minimum.reduceat(scatter(flat, j), starts)
                    digests = [(xxhash.xxh3_64_intdigest(s.tobytes(), seed), xxhash.xxh3_64_intdigest(s.tobytes(), seed + 1)) if len(s) else (0, 0)
                               for s in sets]
                    none = n == 0
                    node, again = (pa.array(signed([d[i] for d in digests]), pa.int64(), mask=none) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(lo, len(sets)), b.column(1).slice(lo, len(sets)), node, again, pa.array(n.astype(np.int32)),
                         *(pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().view(np.int64)))
                           for x in (low, signatures(flat, n))),
                         pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=schema)
            blocks = counts.reshape(-1, BLOCK)
            some = np.flatnonzero(blocks.any(1))
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(some), f.type) for f in list(schema)[:7]), pa.array(some.astype(np.int32)),
                 pa.array([blocks[i].astype("<i8").tobytes() for i in some.tolist()], pa.binary())], schema=schema)

        return self.docs.select("id", "th", "text").mapInArrow(
            run, "id long, th long, node long, again long, n int, keys array<long>, sig array<long>, block int, counts binary")

    def levels(self, described: DataFrame) -> np.ndarray:
        """How common each cell is, one byte each: a block is summed as a stream, and one small row of it reaches the driver."""

        def run(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    total[i] = total.get(i, 0) + np.frombuffer(x, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(
                [np.minimum(8 * np.log2(1 + v), 255).astype(np.uint8).tobytes() for v in total.values()], pa.binary())], ["block", "levels"])

        out = np.zeros(COUNTERS, np.uint8)
        counted = described.where("block IS NOT NULL").select("block", "counts").repartition(COUNTERS // BLOCK // 4, "block")
        for r in counted.mapInArrow(run, "block int, levels binary").collect():
            out[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["levels"], np.uint8)
        return out

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of ``nodes`` (node, id, th): the sorted hashes, packed."""
        k, seed = self.k, self.seed
        wanted = small(nodes.select("node", F.col("id").alias("rep"), F.col("th").alias("at")))
        src = self.docs.join(wanted, F.col("id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("at"))).select("node", "text")

        def run(batches):
            for b in batches:
                for lo, sets in shingle_sets(b.column(1), k):
                    own = [s.tobytes() if len(s) and signed([xxhash.xxh3_64_intdigest(s.tobytes(), seed)])[0] == v else None
                           for s, v in zip(sets, b.column(0).slice(lo, len(sets)).to_pylist())]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(sets)), pa.array(own, pa.binary())], ["node", "set"])

        return src.mapInArrow(run, "node long, set binary").where("set IS NOT NULL").dropDuplicates(["node"])

    def distances(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """(a, b, common, total) of ``pairs`` (a, b): sizes of intersection and union, exact."""
        ends = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node")
                           .select("node", "id", "th"), "jaccard-ends")
        sets = self.sets(ends)  # both joins read one exchange of it
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("merge"), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")

        def run(batches):
            for b in batches:
                common, total = [], []
                for x, y in zip(b.column(2), b.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    n = int((y[at] == x).sum())
                    common.append(n)
                    total.append(len(x) + len(y) - n)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())],
                                                 ["a", "b", "common", "total"])

        return both.mapInArrow(run, "a long, b long, common long, total long")

    def near(self):
        """Condition on (common, total): the similarity reaches the bound."""
        return F.col("common") * self.least.denominator >= F.col("total") * self.least.numerator

    # -- regions --------------------------------------------------------------------------

    def candidates(self, nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
        """(node): the pivots among ``nodes`` that share a group; (a, b): nodes and the pivots of their groups that may be within the bound."""
        own = nodes.select("node", "n", "sig", F.posexplode(F.slice("keys", depth * self.groupings + 1, self.groupings)).alias("j", "low")) \
            .select("node", "n", "sig", F.xxhash64("j", "low").alias("key"))
        groups = materialize(own.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "jaccard-groups")
        members = materialize(join_heavy(own, groups, "key", "size"), "jaccard-members")
        # the typical node of a group has the most company in its other groups as well
        company = members.groupBy("node").agg(F.sum("size").alias("company"), F.count("*").alias("all"))
        order = Window.partitionBy("key").orderBy(F.col("company").desc(), "node")  # cut to PIVOTS rows a key by every task
        first = materialize(members.join(company.hint("merge"), "node").withColumn("rank", F.row_number().over(order))
                            .where(F.col("rank") <= PIVOTS).select("key", "size", "node", "n", "sig", "all"), "jaccard-first")
        pivots = materialize(first.groupBy("node").agg(F.count("*").alias("times"), F.first("all").alias("all")).where("times = all").select("node"), "jaccard-pivots")
        lists = materialize(first.join(pivots, "node").groupBy("key").agg(
            F.collect_list(F.struct("node", "n", "sig")).alias("pivots"), F.first("size").alias("size")), "jaccard-lists")
        tries = join_heavy(members.select("node", "n", "sig", "key"), lists, "key", "size", members.count()) \
            .select("node", "n", "sig", F.explode("pivots").alias("p"))
        near = may_lie_within(F.lit(self.bound), (F.col("n"), F.col("p.n")), (F.col("sig"), F.col("p.sig")))
        return pivots, tries.where((F.col("node") != F.col("p.node")) & near).select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()

    def regions(self, nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
        """(node, region, away) of every node, and the links (a, b) found on the way."""
        radius = self.radii[depth]
        alone = nodes.select("node", F.col("node").alias("region"), F.lit(0.0).alias("away"))
        if not radius:
            return alone, nodes.sparkSession.createDataFrame([], "a long, b long")
        pivots, tries = self.candidates(nodes, depth)
        tried = materialize(self.distances(tries, nodes).where(self.near()), "jaccard-tried")
        away = (1 - F.col("common") / F.col("total")).alias("away")
        stars = tried.select("a", "b", away).where(F.col("away") <= radius + SLACK).join(pivots, F.col("a") == F.col("node"), "left_anti") \
            .groupBy("a").agg(F.min(F.struct("away", "b")).alias("s"))
        out = alone.select("node").join(stars, F.col("node") == F.col("a"), "left").select(
            "node", F.coalesce("s.b", "node").alias("region"), F.coalesce("s.away", F.lit(0.0)).alias("away"))
        return materialize(out, "jaccard-regions"), tried.select("a", "b")

    def tokens(self, described: DataFrame, nodes: DataFrame, regions: DataFrame, levels: np.ndarray, every: bool) -> DataFrame:
        """(w, region, lo, rem): the prefix tokens of each region's members, with the least size of a member that has it there
        and the most tokens left from it on; sizes apart by more than a tenth are stated on their own.  ``every``: all
        rows have a say, and only those of another node's region are looked up; else those of ``nodes``."""
        k, seed, least = self.k, self.seed, self.least
        if every:
            told = described.where("node IS NOT NULL").select("node", "id", "th").join(regions.where("node <> region").hint("merge"), "node").distinct()
        else:
            told = nodes.select("node", "id", "th").join(regions, "node")
        told = materialize(told.select(F.col("id").alias("rep"), F.col("th").alias("at"), "node", "region"), "jaccard-told")
        src = self.docs.join(small(told), F.col("id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("at")), "left" if every else "inner") \
            .select("node", "region", "text")

        def run(batches):
            for b in batches:
                for lo, sets in shingle_sets(b.column(2), k):
                    nodes, regions = (b.column(c).slice(lo, len(sets)).to_pylist() for c in (0, 1))
                    w, region, size, rem = [], [], [], []
                    shared = any(r is not None for r in regions)
                    for s, node, r in zip(sets, nodes, regions):
                        n = len(s)
                        if not n:
                            continue
                        own = int(signed([xxhash.xxh3_64_intdigest(s.tobytes(), seed)])[0])
                        if own != node:
                            if not every:
                                continue
                            r = own
                        first = np.lexsort((s, levels[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:n - math.ceil(least * n) + 1]
                        w.append(s[first])
                        region.append(np.full(len(first), r, np.int64))
                        size.append(np.full(len(first), n, np.int32))
                        rem.append((n - np.arange(len(first))).astype(np.int32))
                    if not w:
                        continue
                    w, region, size, rem = map(np.concatenate, (w, region, size, rem))
                    if shared:
                        step = np.floor(np.log(size) / math.log(1.1)).astype(np.int32)
                        order = np.lexsort((step, region, w))
                        w, region, size, rem, step = (x[order] for x in (w, region, size, rem, step))
                        at = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 0) | (np.diff(region) != 0) | (np.diff(step) != 0)]))
                        w, region, size, rem = w[at], region[at], np.minimum.reduceat(size, at), np.maximum.reduceat(rem, at)
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(region), pa.array(size), pa.array(rem)],
                                                     ["w", "region", "lo", "rem"])

        return src.mapInArrow(run, "w long, region long, lo int, rem int")

    def met(self, tokens: DataFrame, nodes: DataFrame, regions: DataFrame, comps: DataFrame) -> DataFrame:
        """(a, b): pairs of regions, of different components, that share a token with enough left behind it and whose pivots'
        signatures allow a link of members."""
        p, q = self.least.numerator, self.least.denominator
        every = Window.partitionBy("w")
        # a token too far behind for the least partner that has it is of no use either
        shared = materialize(tokens.withColumn("from", F.min("region").over(every)).withColumn("to", F.max("region").over(every))
                             .withColumn("least", F.min("lo").over(every))
                             .where((F.col("from") != F.col("to")) & ((p + q) * F.col("rem") >= p * (F.col("lo") + F.col("least"))))
                             .drop("from", "to", "least"), "jaccard-shared")
        reach = regions.groupBy("region").agg(F.max("away").alias("reach"))
        of = materialize(nodes.select(F.col("node").alias("region"), "n", "sig").join(reach, "region")
                         .join(comps.select(F.col("node").alias("region"), "comp"), "region"), "jaccard-pivots-of")
        told = materialize(shared.join(of.hint("merge"), "region"), "jaccard-told")
        x, y = told.alias("x"), told.alias("y")
        enough = (p + q) * F.least("x.rem", "y.rem") >= p * (F.col("x.lo") + F.col("y.lo"))
        near = may_lie_within(F.col("x.reach") + F.col("y.reach") + self.bound, (F.col("x.n"), F.col("y.n")), (F.col("x.sig"), F.col("y.sig")))
        pairs = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.comp") < F.col("y.comp")) & enough & near)
        return pairs.select(F.least("x.region", "y.region").alias("a"), F.greatest("x.region", "y.region").alias("b")).distinct()

    def components(self, nodes: DataFrame, links: DataFrame) -> DataFrame:
        """(node, comp) of all ``nodes``."""
        linked = components(links).toDF("linked", "root")
        return materialize(nodes.select("node").join(linked, F.col("node") == F.col("linked"), "left")
                           .select("node", F.coalesce("root", "node").alias("comp")), "jaccard-comps")

    def boundary(self, apart: DataFrame, regions: DataFrame, comps: DataFrame) -> DataFrame:
        """(node): members of regions whose pivots lie ``apart`` (a, b, away) within the windows, components being different."""
        reach = regions.groupBy("region").agg(F.max("away").alias("reach"))
        of = regions.where("node = region").select("region").join(reach, "region").join(comps.select(F.col("node").alias("region"), "comp"), "region")
        of = materialize(of, "jaccard-reach")
        both = apart.join(of.toDF("a", "ra", "ca").hint("merge"), "a").join(of.toDF("b", "rb", "cb").hint("merge"), "b") \
            .where((F.col("ca") != F.col("cb")) & (F.col("away") <= F.col("ra") + F.col("rb") + self.bound + SLACK) & (F.col("ra") + F.col("rb") > 0))
        # the least distance from its pivot that a member needs, by region
        need = both.select(F.col("a").alias("region"), (F.col("away") - self.bound - F.col("rb") - SLACK).alias("need")).union(
            both.select("b", F.col("away") - self.bound - F.col("ra") - SLACK)).groupBy("region").agg(F.min("need").alias("need"))
        return regions.join(need, "region").where("away >= need").select("node").distinct()

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The described rows, the nodes, and (node, comp) of the nodes that are linked."""
        while True:
            described = materialize(self.describe(), "jaccard-rows")
            rows = described.where("node IS NOT NULL")
            rep = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "th"))
            nodes = materialize(rows.groupBy("node").agg(
                rep.alias("rep"), F.min("again").alias("lo"), F.max("again").alias("hi"), F.min("keys").alias("keys"),
                F.min("n").alias("n"), F.min("sig").alias("sig"))
                .select("node", "rep.id", "rep.th", "lo", "hi", "keys", "n", "sig"), "jaccard-nodes")
            if not nodes.where("lo <> hi").limit(1).count():
                break
            self.seed += 2  # two sets agree in their first digest
        levels = self.levels(described)
        left, links, comps = nodes.select("node", "id", "th", "keys", "n", "sig"), nodes.sparkSession.createDataFrame([], "a long, b long"), None
        for depth in range(len(self.radii)):
            regions, found = self.regions(left, depth)
            if self.radii[depth]:
                links = materialize(links.union(found), "jaccard-links")
                comps = self.components(nodes, links)
            elif comps is None:
                comps = nodes.select("node", F.col("node").alias("comp"))
            pairs = materialize(self.met(self.tokens(described, left, regions, levels, depth == 0), left, regions, comps), f"jaccard-pairs-{depth}")
            measured = materialize(self.distances(pairs, left), f"jaccard-distances-{depth}")
            links = materialize(links.union(measured.where(self.near()).select("a", "b")), "jaccard-links")
            comps = self.components(nodes, links)
            if depth + 1 < len(self.radii):
                apart = measured.where(~self.near()).select("a", "b", (1 - F.col("common") / F.col("total")).alias("away"))
                edge = materialize(self.boundary(apart, regions, comps), "jaccard-boundary")
                if not edge.limit(1).count():
                    break
                left = materialize(left.join(edge, "node"), "jaccard-left")
        return described, nodes, comps


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: Fraction = LEAST,
                    groupings: int = GROUPINGS, radii: tuple = RADII) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    described, nodes, comps = Join(src, words, Fraction(least), groupings, tuple(radii)).run()
    first = comps.join(nodes.select("node", "id"), "node")
    names = materialize(first.groupBy("comp").agg(F.min("id").alias("component_id")), "jaccard-names")
    named = materialize(comps.join(names, "comp").select(F.col("node").alias("at"), "component_id"), "jaccard-named")
    rows = described.where("block IS NULL").select("id", "node", "n")
    return rows.join(named, F.col("node") == F.col("at"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
