"""Vector code compression: product codes by exact limb-split matrix products.

A component ``x`` becomes the integer ``floor(256 * x)``; a vector is cut into ``PARTS``
equal parts, and each part is coded by the place of its nearest codebook entry.
Distances come from ``|x|^2 - 2 x.c + |c|^2`` in integers.  The dot products run as
float64 matrix products all the same: the integers are broken into limbs so short
that every sum of limb products stays below 2^53, where float64 is exact, and the
limb products are shifted and added in int64.  The first least distance wins, so
ties go to the lower entry on every machine.

Each of the ``ROUNDS`` updates is one pass over the vectors: a task adds up the parts
its rows assign to each entry, and only these sums (of a size fixed by the codebook)
travel.  The codebook is the one thing every task gets: ``ENTRIES`` x dimension integers.

Edge cases: null and empty vectors and vectors with null or non-finite components are
dropped; so are vectors of another length than that of the smallest id kept, which
cannot be cut alike.  A length that ``PARTS`` does not divide is filled up with zeros.
Rows without an id are coded and counted like any other but start no entry; the rows
of a repeated id are coded each and start one entry (the least of their vectors); with
fewer ids than entries the codebook has one entry per id.  Numbers too large for int64
distances are computed with Python's integers; an error beyond a long is null and left
out of the label's sum.  No kept row with an id: the codebook is empty, and so is the result.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Float64 holds every integer up to this power of two.
EXACT_BITS = 53
#: Rows of one matrix product.
CHUNK = 1024
LONG = (1 << 63) - 1


def usable(vec: Column) -> Column:
    """Not null, not empty, no null or non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & (F.size(vec) > 0), F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as int64 where all fit and as Python integers elsewhere."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0 ** 53:
        return np.floor(x * SCALE).astype(np.int64)
    flat = [int(v) * SCALE if abs(v) >= 2.0 ** 53 else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def split(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows x parts x part length, filled up with zeros."""
    width = -(-x.shape[1] // parts)
    out = np.zeros((len(x), parts, width), x.dtype)
    out.reshape(len(x), -1)[:, :x.shape[1]] = x
    return out


def largest(*arrays: np.ndarray) -> int:
    return max((int(np.abs(a).max()) for a in arrays if a.size), default=0)


def limbs(x: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    """``n`` float64 limbs of ``bits`` bits, lowest first; the last one carries the sign."""
    low = [(x >> (i * bits)) & ((1 << bits) - 1) for i in range(n - 1)]
    return [a.astype(np.float64) for a in (*low, x >> ((n - 1) * bits))]


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact x.c of every row and entry, part by part: (parts, rows, width) and (parts, entries, width)."""
    width = max(x.shape[2], 1)
    bits = (EXACT_BITS - (width - 1).bit_length()) // 2
    n = -(-(largest(x, c).bit_length() + 1) // bits)
    a, b = limbs(x, bits, n), [v.transpose(0, 2, 1) for v in limbs(c, bits, n)]
    out = np.zeros((x.shape[0], x.shape[1], c.shape[1]), np.int64)
    for i, v in enumerate(a):
        for j, w in enumerate(b):
            if (i + j) * bits < 63:  # higher limbs of a product that fits are sign alone, and vanish modulo 2^64
                out += np.matmul(v, w).astype(np.int64) << ((i + j) * bits)
    return out


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part of the rows ``x`` (rows, parts, width); ties to the lower entry."""
    width = max(x.shape[2], 1)
    if x.dtype == object or books.dtype == object or width * (2 * largest(x, books)) ** 2 > LONG:
        d = np.array([((row[:, None, :].astype(object) - books.astype(object)) ** 2).sum(2) for row in x], object).reshape(
            len(x), len(books), -1)
        at = np.array([[min(range(len(p)), key=p.__getitem__) for p in row.tolist()] for row in d], np.int64)
        return at, np.take_along_axis(d, at[:, :, None], 2)[:, :, 0]
    at, best = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    size = (books * books).sum(2)
    for lo in range(0, len(x), CHUNK):
        part = np.ascontiguousarray(x[lo:lo + CHUNK].transpose(1, 0, 2))
        d = size[:, None, :] - 2 * dots(part, books)
        first = d.argmin(2)
        at[lo:lo + CHUNK] = first.T
        best[lo:lo + CHUNK] = np.take_along_axis(d, first[:, :, None], 2)[:, :, 0].T + (part * part).sum(2).T
    return at, best


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def cell_sums(vectors: DataFrame, dim: int, books: np.ndarray) -> DataFrame:
    """(cell, v): over all rows, the sums of the parts given to each entry, and behind them the counts."""
    parts, entries, width = books.shape

    def run(batches):
        total, count = np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64)
        for b in batches:
            if b.num_rows:
                x = split(rows_of(b.column(0), dim), parts)
                at, _ = assign(x, books)
                cells = (at + np.arange(parts) * entries).ravel()
                sums = np.zeros((parts * entries, width), x.dtype)
                np.add.at(sums, cells, x.reshape(-1, width))
                total += sums
                count += np.bincount(cells, minlength=parts * entries)
        flat = [*total.ravel().tolist(), *count.tolist()]
        seen = [i for i, v in enumerate(flat) if v]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array([Decimal(int(flat[i])) for i in seen], pa.decimal128(38, 0))],
                                         ["cell", "v"])

    return vectors.mapInArrow(run, "cell long, v decimal(38,0)").groupBy("cell").agg(F.sum("v").alias("v"))


def moved(books: np.ndarray, sums: list) -> np.ndarray:
    """The codebooks after an update; entries without parts stay."""
    parts, entries, width = books.shape
    n = parts * entries * width
    flat, count = [0] * n, [0] * (parts * entries)
    for r in sums:
        if r["cell"] < n:
            flat[r["cell"]] = int(r["v"])
        else:
            count[r["cell"] - n] = int(r["v"])
    old = books.ravel().tolist()
    new = [flat[i] // count[i // width] if count[i // width] else old[i] for i in range(n)]
    return narrow(np.array(new, object).reshape(books.shape))


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if largest(x) <= LONG >> 1 else x


def start(vectors: DataFrame, entries: int) -> list:
    """The rows (id, vec) of the smallest ids, ascending; of a repeated id the least vector."""
    ids = vectors.where("id IS NOT NULL").select("id").distinct().orderBy("id").limit(entries).collect()
    if not ids:
        return []
    wanted = vectors.where(F.col("id").between(ids[0]["id"], ids[-1]["id"]))
    return sorted(wanted.groupBy("id").agg(F.min("vec").alias("vec")).collect(), key=lambda r: r["id"])


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, np.ndarray] | None:
    """Vector length and codebooks (parts, entries, width) of usable ``vectors`` (id, vec); None without rows that have an id."""
    first = start(vectors, entries)
    if not first:
        return None
    dim = len(first[0]["vec"])
    if any(len(r["vec"]) != dim for r in first):
        first = start(vectors.where(F.size("vec") == dim), entries)
    books = narrow(split(integers(np.array([r["vec"] for r in first])), parts).transpose(1, 0, 2).astype(object))
    alike = vectors.where(F.size("vec") == dim).select("vec")
    for _ in range(rounds):
        books = moved(books, cell_sums(alike, dim, books).collect())
    return dim, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of ``vectors``."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    src = vectors.where(usable(F.col(vec))).select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    got = train(src.select("id", "vec"), parts, entries, rounds)
    kind = dict(src.dtypes)["label"]
    if got is None:
        return src.where(F.lit(False)).select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                              F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dim, books = got

    def run(batches):
        for b in batches:
            at, best = assign(split(rows_of(b.column(2), dim), parts), books) if b.num_rows else (np.zeros((0, parts), int), np.zeros((0, parts), int))
            total = [sum(row) for row in best.tolist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([bytes(row).hex() for row in at.tolist()], pa.string()),
                 pa.array([v if v <= LONG else None for v in total], pa.int64())], ["id", "label", "code", "error"])

    coded = materialize(src.where(F.size("vec") == dim).mapInArrow(run, f"id long, label {kind}, code string, error long"), "vector-codes")
    per_label = materialize(coded.groupBy(F.col("label").alias("of")).agg(
        F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    return coded.join(small(per_label), F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (SELECT rid, p, min(list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {entries} + e) AS best
         FROM pts JOIN b{r} USING (p) GROUP BY rid, p)""")
        if r < rounds:
            steps.append(f"""
u{r} AS (SELECT p, e, i, sum(x)::HUGEINT AS t, count(*)::HUGEINT AS n FROM
         (SELECT p, (best % {entries})::INT AS e, unnest(s) AS x, unnest(range(len(s))) AS i FROM a{r} JOIN pts USING (rid, p)) GROUP BY p, e, i),
m{r} AS (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM u{r} GROUP BY p, e),
b{r + 1} AS (SELECT p, e, coalesce(m{r}.c::BIGINT[], b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))""")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
              FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pts AS (SELECT rid, vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS s
        FROM (SELECT rid, vec_id, v, unnest(range({parts})) AS p FROM kept)),
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
b0 AS (SELECT p, e, min(s) AS c FROM pts JOIN ids USING (vec_id) GROUP BY p, e),{",".join(steps)},
sha AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM
        (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM b{rounds})),
done AS (SELECT rid, string_agg(printf('%02x', (best % {entries})::INT), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error
         FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM sha) AS codebooks_sha256
FROM done JOIN kept USING (rid)"""
