"""Quantiles of numeric columns, exact or approximate, at any scale (M4).

Exact quantiles use linear interpolation between the two closest ranks (the
rule of pandas ``quantile`` and SQL ``quantile_cont``).  Spark's built-in exact
``percentile`` keeps a value->count map of *every distinct value* and, for a
global aggregate, merges it in one task; on a high-cardinality column of a
large table that task runs out of memory.  Here the exact answer is found by
refinement instead, and only bounded histograms ever reach the driver:

1. one pass over all rows: counts, finite min/max and a mergeable KLL sketch of
   every column, next to whatever other aggregates the caller wants; the
   sketch brackets each wanted rank with several times its error (columns of
   few rows are one bracket);
2. one pass: every row gives one entry per column, the stretch its value falls
   in: a bracket or a gap between brackets.  Entries are counted by (column,
   stretch, bucket) with partial aggregation, so a hot value costs one row per
   task.  The gaps' counts place the brackets exactly; the bucket that holds
   a wanted rank becomes the next bracket.  A bracket of few rows has its
   values as buckets, and the rank is read off exactly.  Brackets that were
   wide are refined in further passes, each narrowing them by ``buckets`` times.

A rank that the sketch missed lies in a gap, which is then the next bracket: a
bad sketch costs a pass, never a wrong answer.  The plan holds one entry per
column, whatever the number of quantiles, so wide tables stay cheap to plan.
NULL and NaN are ignored; +-infinity are ordinary, extreme values.

Values are compared as DOUBLE: BIGINT and DECIMAL values beyond 2**53 come back
as the nearest double.

``error=`` asks for the approximate answer in a single pass instead: Spark's
Greenwald-Khanna sketch, the same as ``DataFrame.approxQuantile``.
"""

from __future__ import annotations

import logging
import math
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.columns import qcol, resolve_columns

log = logging.getLogger(__name__)

DEFAULT_ACCURACY = 1_024    # the KLL sketch's k
DEFAULT_BUCKETS = 2_048
DEFAULT_LOCAL_ROWS = 20_000


def quantiles(df: DataFrame, columns: list[str] | None, probs: list[float], *,
              error: float | None = None, accuracy: int = DEFAULT_ACCURACY,
              buckets: int = DEFAULT_BUCKETS,
              local_rows: int = DEFAULT_LOCAL_ROWS) -> dict[str, list[float | None]]:
    """Quantiles of each numeric column: ``{column: [q(p) for p in probs]}``.

    ``error=None`` (default) is exact; ``error=e`` is the one-pass approximate
    answer with relative rank error ``e``.  Columns with no value give None.
    """
    cols = resolve_columns(df, columns, numeric=True)
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability {p} outside [0, 1]")
    if not cols:
        return {}
    if error is not None:
        return approx_quantiles(df, cols, probs, error)
    return _Refiner(df, cols, list(probs), accuracy, buckets, local_rows).run()[0]


def quantiles_and_aggregates(df: DataFrame, columns: list[str], probs: list[float],
                             extra: list, **kw) -> tuple[dict, object]:
    """Exact quantiles plus other aggregates of ``df`` computed in the same first pass.

    ``extra`` are aggregate columns over ``df``'s own columns; returns
    (quantiles, row of the extra aggregates).
    """
    cols = resolve_columns(df, columns, numeric=True)
    if not cols:
        return {}, df.agg(*extra).first() if extra else None
    r = _Refiner(df, cols, list(probs), kw.get("accuracy", DEFAULT_ACCURACY),
                 kw.get("buckets", DEFAULT_BUCKETS), kw.get("local_rows", DEFAULT_LOCAL_ROWS),
                 extra=extra)
    return r.run()


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     error: float) -> dict[str, list[float | None]]:
    if error <= 0:
        raise ValueError("error must be > 0; use error=None for exact quantiles")
    acc = max(1, math.ceil(1.0 / error))
    aggs = [F.percentile_approx(_valid_value(c), list(probs), acc).alias(f"q{i}")
            for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        vals = row[f"q{i}"]
        out[c] = [None] * len(probs) if vals is None else [float(v) for v in vals]
    return out


def _value(c: str):
    return qcol(c).cast("double")


def _valid_value(c: str):
    """The column as double with NaN turned into NULL (NaN is not a value)."""
    x = _value(c)
    return F.when(~F.isnan(x), x)


@dataclass
class _Bracket:
    """A stretch [lo, hi] of one column that holds wanted ranks."""
    lo: float
    hi: float
    exact: bool                    # count values one by one (else buckets of equal width)
    ranks: set[int] = field(default_factory=set)


class _Refiner:
    def __init__(self, df, cols, probs, accuracy, buckets, local_rows, extra=None):
        self.src, self.extra = df, list(extra or [])
        # only float / double columns can hold NaN or +-infinity
        types = {f.name: f.dataType for f in df.schema.fields}
        self.fractional = [isinstance(types[c], (FloatType, DoubleType)) for c in cols]
        # column expressions are built once: each one costs JVM round trips
        self.xs = [self._finite(c, i) for i, c in enumerate(cols)]
        self.cols, self.probs = cols, probs
        self.accuracy, self.buckets, self.local_rows = accuracy, buckets, local_rows
        self.answers: dict[tuple[int, int], float] = {}   # (column, rank) -> value
        self.ninf: dict[int, int] = {}                     # -inf count per column
        self.ranges: dict[int, tuple] = {}                 # finite (min, max, count)

    def _finite(self, name: str, i: int):
        """Column as double; NaN and +-infinity become NULL."""
        if not self.fractional[i]:
            return qcol(name).cast("double")
        x = _value(name)
        return F.when(F.abs(x) < F.lit(float("inf")), x)

    # -- pass 1: counts, finite range and a sketch --------------------------------
    def run(self) -> tuple[dict[str, list[float | None]], object]:
        aggs = []
        for i, c in enumerate(self.cols):
            x = self.xs[i]
            for name, v in (("ni", "-inf"), ("pi", "inf")):
                n = F.count_if(_value(c) == F.lit(float(v))) if self.fractional[i] else F.lit(0).cast("bigint")
                aggs.append(n.alias(f"{name}{i}"))
            aggs.append(F.kll_sketch_agg_double(x, F.lit(self.accuracy)).alias(f"__k{i}"))
        t0 = time.perf_counter()
        marks = self._marks()
        head = self.src.agg(*aggs, *self.extra)
        # a sketch knows its exact count, least and greatest value; only numbers reach the driver
        bars = []
        for i in range(len(self.cols)):
            k, n = F.col(f"__k{i}"), F.coalesce(F.kll_sketch_get_n_double(f"__k{i}"), F.lit(0).cast("bigint"))
            q = F.when(n > 0, F.kll_sketch_get_quantile_double(k, F.array(F.lit(0.0), F.lit(1.0), *map(F.lit, marks))))
            bars += [n.alias(f"n{i}"), F.get(q, F.lit(0)).alias(f"mn{i}"), F.get(q, F.lit(1)).alias(f"mx{i}"),
                     F.slice(q, 3, len(marks)).alias(f"__q{i}")]
        head = head.select("*", *bars).drop(*(f"__k{i}" for i in range(len(self.cols)))).first()
        log.debug("quantiles: range and sketch pass %.2fs", time.perf_counter() - t0)

        wanted: dict[int, list[tuple[int, int, float]]] = {}
        todo: dict[int, list[_Bracket]] = {}
        for i in range(len(self.cols)):
            n, ninf, pinf = head[f"n{i}"], head[f"ni{i}"], head[f"pi{i}"]
            total = n + ninf + pinf
            self.ninf[i] = ninf
            self.ranges[i] = (head[f"mn{i}"], head[f"mx{i}"], n)
            wanted[i] = []
            found: list[_Bracket] = []
            for p in self.probs if total else []:
                h = p * (total - 1)
                r0, r1 = math.floor(h), math.ceil(h)
                wanted[i].append((r0, r1, h - r0))
                for r in {r0, r1}:
                    if r < ninf:
                        self.answers[(i, r)] = float("-inf")
                    elif r >= ninf + n:
                        self.answers[(i, r)] = float("inf")
                    else:
                        found.append(self._first(i, r, dict(zip(marks, head[f"__q{i}"]))))
            if found:
                todo[i] = self._disjoint(found)
        while todo:
            todo = self._refine(todo)

        out = {}
        for i, c in enumerate(self.cols):
            vals = []
            for r0, r1, frac in wanted[i]:
                a, b = self.answers[(i, r0)], self.answers[(i, r1)]
                vals.append(a if r0 == r1 or a == b else a + (b - a) * frac)
            out[c] = vals if wanted[i] else [None] * len(self.probs)
        return out, head

    def _margin(self) -> float:
        """Several times the sketch's rank error."""
        return min(0.5, 3 * 2.3 / self.accuracy ** 0.9)

    def _marks(self) -> list[float]:
        """The sketch quantiles that may end a bracket."""
        m = self._margin()
        return sorted({min(1.0, max(0.0, p + d)) for p in self.probs for d in (-m, m)})

    def _first(self, i: int, rank: int, bars: dict[float, float]) -> _Bracket:
        """The sketch's bracket of a rank; the whole finite range for a small column."""
        mn, mx, n = self.ranges[i]
        lo, hi = float(mn), float(mx)
        if n > self.local_rows:
            q, m = (rank - self.ninf[i]) / max(n - 1, 1), self._margin()
            # infinities shift q away from the wanted probability: marks on its outer sides still hold it
            lo = max([v for p, v in bars.items() if p <= q - m / 2], default=lo)
            hi = min([v for p, v in bars.items() if p >= q + m / 2], default=hi)
            n = int(2 * m * n) if lo < hi else 0
        return _Bracket(min(lo, hi), max(lo, hi), n <= self.local_rows, {rank})

    @staticmethod
    def _disjoint(brackets: list[_Bracket]) -> list[_Bracket]:
        """Brackets of one column in order, overlapping ones as one."""
        out: list[_Bracket] = []
        for b in sorted(brackets, key=lambda b: (b.lo, b.hi)):
            if out and b.lo <= out[-1].hi:
                last = out[-1]
                last.hi, last.exact = max(last.hi, b.hi), last.exact and b.exact
                last.ranks |= b.ranks
            else:
                out.append(b)
        return out

    # -- one refinement step over every open bracket --------------------------------
    def _stretch(self, i: int, brackets: list[_Bracket]):
        """The stretch of a column's value: 2j for the gap below bracket j, 2j + 1 inside it."""
        x = self.xs[i]
        out = F.when(x < F.lit(brackets[0].lo), 0)
        for j, b in enumerate(brackets):
            if j:
                out = out.when(x < F.lit(b.lo), 2 * j)
            out = out.when(x <= F.lit(b.hi), 2 * j + 1)
        return out.otherwise(2 * len(brackets))

    def _buckets(self, todo: dict[int, list[_Bracket]]):
        """The bucket of an exploded entry (g, s, x): nothing in a gap, the value or its share of the bracket inside one."""
        x, inside = F.col("e.x"), F.col("e.s") % 2 == 1
        flat = [(i, b) for i, bs in todo.items() for b in bs]
        if all(b.exact or b.lo == b.hi for _, b in flat):
            return F.when(inside, x)
        # literal tables of the brackets' ends, by the bracket's place among all
        starts, n = {}, 1
        for i, bs in todo.items():
            starts[i], n = n, n + len(bs)
        at = (F.element_at(F.array(*[F.lit(starts.get(i, 0)) for i in range(max(starts) + 1)]), F.col("e.g") + 1)
              + F.floor(F.col("e.s") / 2).cast("int"))
        lo, hi = (F.element_at(F.array(*[F.lit(v / 2) for v in ends]), at) for ends in ([b.lo for _, b in flat], [b.hi for _, b in flat]))
        exact = F.element_at(F.array(*[F.lit(b.exact or b.lo == b.hi) for _, b in flat]), at)
        share = F.least(F.lit(self.buckets - 1), F.floor((x / 2 - lo) / (hi - lo) * F.lit(self.buckets))).cast("double")
        return F.when(inside, F.when(exact, x).otherwise(share))

    def _refine(self, todo: dict[int, list[_Bracket]]) -> dict[int, list[_Bracket]]:
        """Count the rows of every stretch and bucket in one scan, then narrow each bracket to the wanted bucket."""
        t0 = time.perf_counter()
        # one small expression per column: the generated code of a wide table must stay small to be compiled
        entries = [F.struct(F.lit(i).alias("g"), self._stretch(i, bs).alias("s"), self.xs[i].alias("x")) for i, bs in todo.items()]
        hist = (self.src.select(F.explode(F.array(*entries)).alias("e")).where("e.x IS NOT NULL")
                .groupBy(F.col("e.g").alias("g"), F.col("e.s").alias("s"), self._buckets(todo).alias("key"))
                .agg(F.count(F.lit(1)).alias("cnt"), F.min("e.x").alias("mn"), F.max("e.x").alias("mx"))).collect()
        log.debug("quantiles: histogram pass %.2fs (%d columns, %d groups)", time.perf_counter() - t0, len(todo), len(hist))
        groups: dict[tuple[int, int], list] = {}
        for row in hist:
            groups.setdefault((row["g"], row["s"]), []).append(row)
        nxt: dict[int, list[_Bracket]] = {}
        for i, brackets in todo.items():
            stretches = []                       # (rows before, rows, parts in order) of each stretch
            before = self.ninf[i]
            for s in range(2 * len(brackets) + 1):
                rows = sorted(groups.get((i, s), []), key=lambda r: (r["key"] is not None, r["key"]))
                n = sum(r["cnt"] for r in rows)
                stretches.append((before, n, rows))
                before += n
            found = []
            for rank in sorted(set().union(*(b.ranks for b in brackets))):
                cum, _, rows = next(x for x in stretches if x[0] <= rank < x[0] + x[1])
                for r in rows:
                    if cum + r["cnt"] > rank:
                        break
                    cum += r["cnt"]
                lo, hi = float(r["mn"]), float(r["mx"])
                if lo == hi:
                    self.answers[(i, rank)] = lo
                else:
                    # no narrowing (width at float resolution): count values
                    stuck = any((lo, hi) == (b.lo, b.hi) for b in brackets)
                    found.append(_Bracket(lo, hi, r["cnt"] <= self.local_rows or stuck, {rank}))
            if found:
                nxt[i] = self._disjoint(found)
        return nxt
