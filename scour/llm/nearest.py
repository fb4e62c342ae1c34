"""Nearest neighbours of a stated query set by a block matrix join.

Vectors are packed into blocks; every query block meets every candidate block in
one int8 product.  A unit vector ``x`` is stored as ``s * q`` with ``q`` int8, and the
length of what rounding lost is kept beside it, so by Cauchy-Schwarz

    |x.y - (s q).(t r)|  <=  |x - s q| + |s q| |y - t r|

bounds the error of each approximate cosine.  A pair survives when its upper
bound reaches the k-th best lower bound of its query in the tile; only survivors
are computed again, in double precision on the original vectors.  Tiles give at
most k rows a query (ties of the k-th included by the smaller id).

The query set is stated by the caller (here: ids divisible by 50); it is dealt to
the candidate blocks in blocks, by a shuffle, never by a broadcast.  Consecutive candidate
blocks make slots of at most ``HELD`` bytes, and a slot is a partition.  A task holds its
slot and lets the query blocks pass: the heaps of one query block are merged over the slot's
blocks, emitted and dropped before the next one comes, so its memory does not grow with
the queries.  Every candidate is tried: recall is 1.

Edge cases: null vectors, zero vectors and vectors with null or non-finite
components take no part; vectors of another length than the query's are not
comparable and are skipped; a query's own id is left out, so repeated rows of a
query's id are too; an id with several vectors, asked for or found, counts with the best
score over them; fewer candidates than k give them all; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

#: Vectors of a block; a tile of products is CANDIDATES x QUERIES.
CANDIDATES, QUERIES = 2048, 512
INT8 = 127
#: Bytes of candidate vectors that a task holds.
HELD = 64 << 20


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, and not the zero vector."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, the lengths of the codes and of the rounding errors."""
    x = scaled(x)
    unit = x / norms(x)[:, None]
    scale = np.abs(unit).max(1) / INT8
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.sqrt((near ** 2).sum(1)), np.sqrt(((unit - near) ** 2).sum(1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two (exactly), so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row cosine in double precision; a row's value depends on its two vectors alone."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (norms(a) * norms(b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes: sums below 2**24 are whole in float32, below 2**53 in float64."""
    kind = np.float32 if a.shape[1] * INT8 * INT8 < 1 << 24 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, codes: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, cosine) of each query's k best of one block, ties by smaller id; ``codes``: the block's, if known."""
    qc, qs, ql, qe = quantise(q)
    cc, cs, _, ce = codes or quantise(c)
    about = products(qc, cc) * qs[:, None] * cs
    error = qe[:, None] + ql[:, None] * ce + 1e-12
    own = qid[:, None] == cid
    low = np.where(own, -np.inf, about - error)
    # the same id may stand in the block twice, so the bar is the k-th best among distinct ids
    bar = low[:, np.unique(cid, return_index=True)[1]]
    n = bar.shape[1]
    bar = np.partition(bar, n - k, axis=1)[:, n - k] if n > k else np.full(len(qid), -np.inf)
    i, j = np.nonzero((about + error >= bar[:, None]) & ~own)
    score = np.empty(len(i))
    for lo in range(0, len(i), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        score[s] = cosine(q[i[s]], c[j[s]])
    order = np.lexsort((cid[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    out, last, seen = [], -1, set()
    for p, (a, b) in enumerate(zip(i.tolist(), cid[j].tolist())):
        if a != last:
            last, seen = a, set()
        if len(seen) < k and b not in seen:
            seen.add(b)
            out.append(p)
    return qid[i[out]], cid[j[out]], score[out]


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` usable vectors of one length: __dim, __ids and __data (little-endian doubles or floats)."""
    wide = vectors.schema["vec"].dataType.elementType.typeName() != "float"
    kind = "<f8" if wide else "<f4"

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            lists = b.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(n)
            for v, a, z in zip(b.column(0).to_pylist(), (ends - n).tolist(), ends.tolist()):
                part = held.setdefault(z - a, [])
                part.append((v, flat[a:z]))
                if len(part) == size:
                    yield pack(held.pop(z - a))
        for part in held.values():
            yield pack(part)

    def pack(part):
        ids = np.array([v for v, _ in part], "<i8").tobytes()
        data = np.concatenate([x for _, x in part])
        return pa.RecordBatch.from_pydict({"__dim": pa.array([len(part[0][1])], pa.int32()), "__ids": pa.array([ids], pa.binary()),
                                           "__data": pa.array([data.tobytes()], pa.binary())})

    return vectors.mapInArrow(run, "__dim int, __ids binary, __data binary")


def search(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vec: str = "embedding",
           candidates: int = CANDIDATES, block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's ``k`` nearest by cosine, ties to the smaller id.

    ``queries`` is a condition on the rows of ``vectors`` that states the query set.
    """
    kind = "<f8" if vectors.schema[vec].dataType.elementType.typeName() != "float" else "<f4"
    ok = vectors.where(usable(F.col(vec)) & F.col(vec_id).isNotNull())
    rows = ok.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("vec"))
    asked = ok.where(queries).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("vec")).distinct()
    # written blocks keep their rows and numbers, whatever executor is lost
    c = numbered(materialize(blocks(rows, candidates).select(F.monotonically_increasing_id().alias("at"), "*"), "nn-rows"))
    q = materialize(blocks(asked, block).select(F.monotonically_increasing_id().alias("n"), "*"), "nn-queries")
    count, most = c.agg(F.count("*"), F.coalesce(F.max(F.octet_length("__data")), F.lit(1))).first()
    if not count:
        return merge(rows.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0), k)
    held = max(1, min(HELD // most, count // (2 * vectors.sparkSession.sparkContext.defaultParallelism)))
    slots = -(-count // held)
    cols = ["slot", "kind", "n", "__dim", "__ids", "__data"]
    dealt = c.select(F.floor(F.col("n") / held).cast("int").alias("slot"), F.lit(0).alias("kind"), *cols[2:]).unionByName(
        q.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(1).alias("kind"), *cols[2:]))
    streams = dealt.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "kind", "n").select("slot", "kind", "__dim", "__ids", "__data")

    def run(batches):
        now, slot = None, []
        for b in batches:
            for r in range(b.num_rows):
                at, asks, dim = (b.column(i)[r].as_py() for i in range(3))
                ids = np.frombuffer(b.column(3)[r].as_buffer(), "<i8")
                data = np.frombuffer(b.column(4)[r].as_buffer(), kind).reshape(-1, dim).astype(np.float64)
                if at != now:
                    now, slot = at, []
                if not asks:
                    slot.append((ids, data, quantise(data)))
                    continue
                heaps: dict[int, list] = {}
                for own, vecs, codes in slot:
                    if vecs.shape[1] == dim:
                        push(heaps, k, *tile(ids, data, own, vecs, k, codes))
                out = [(a, -d, s) for a, heap in heaps.items() for s, d in heap]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                        zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return merge(streams.mapInArrow(run, "query_id long, vec_id long, score double"), k)


def numbered(blocks: DataFrame) -> DataFrame:
    """Written blocks with n, their places without gaps, from ``at`` (monotonically increasing): partitions are counted, not rows ranked."""
    part = F.shiftright("at", 33).alias("part")
    counts = blocks.groupBy(part).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = materialize(counts.select("part", F.coalesce(before, F.lit(0)).alias("begin")), "nn-begins")
    return blocks.withColumn("part", F.shiftright("at", 33)).join(small(begins), "part") \
        .withColumn("n", F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "begin", "at")


def push(heaps: dict[int, list], k: int, queries: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
    """Keep the k best distinct candidates (score, -id) of each query."""
    for a, d, s in zip(queries.tolist(), found.tolist(), scores.tolist()):
        heap, item = heaps.setdefault(a, []), (s, -d)
        same = [x for x in heap if x[1] == -d]
        if same and same[0] >= item:
            continue
        if same:
            heap.remove(same[0])
            heapq.heapify(heap)
        if len(heap) < k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)


def merge(found: DataFrame, k: int) -> DataFrame:
    """The k best distinct candidates of each query over all slots."""
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
