"""Mixture-controlled packing of tokenised documents into fixed windows.

Every source is a queue of its documents' tokens.  Windows are filled by deficit
round-robin: at each window a queue earns its share of the window, is served the
whole tokens it has earned, and keeps the fraction as its deficit for the next
window; a queue that runs dry leaves its share to the others.  Documents are cut
where a turn ends, so windows are full (only the last one may need padding) and
every window holds the sources in the target proportions, to within a token.

The scheduler never runs window after window.  Token ``j`` (from 0) of queue
``s`` with weight ``w`` falls due at ``(j + 0.5) / w``: the moment the queue's
credit, rounded, covers it.  Serving in order of due time, ties by queue, *is*
the round-robin with carried deficits, and the number of tokens each queue has
been served after ``n`` windows (``Schedule.served``) follows from the queues'
lengths alone.  So each task lays out its own documents, and the deficits carry
over windows and partitions without any task waiting for another.

Steps: one Arrow pass encodes the texts and writes ids with running positions
per (partition, source); the partition totals are prefix-summed; a second Arrow
pass cuts the documents at window ends.  No key is ever gathered: a source that
holds a third of all rows is spread over its partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, small

WINDOW = 2048
END_ID = 1
#: The mixture is named by people; more queues than this is a mistaken source column.
MAX_SOURCES = 100_000


class Schedule:
    """How many tokens each queue has been served after a number of windows."""

    def __init__(self, lengths: np.ndarray, weights: np.ndarray, window: int = WINDOW):
        self.t = np.asarray(lengths, np.int64)
        self.w = np.asarray(weights, np.float64)
        self.window = window
        self.total = int(self.t.sum())
        order = np.argsort(self.t / self.w, kind="stable")
        dry = (self.t / self.w)[order]
        rate = self.w.sum() - np.concatenate([[0.0], np.cumsum(self.w[order])[:-1]])
        served = np.concatenate([[0.0], np.cumsum(self.t[order])[:-1]]) + dry * rate
        self.dry, self.at = np.concatenate([[0.0], dry]), np.concatenate([[0.0], served])

    def time(self, served: np.ndarray) -> np.ndarray:
        """About when so many tokens have been served together."""
        return np.interp(served, self.at, self.dry)

    def tokens(self, time: np.ndarray) -> np.ndarray:
        """About how many tokens have been served together by then."""
        return np.interp(time, self.dry, self.at)

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Matrix (windows x queues): exactly the tokens with the earliest due times."""
        goal = np.minimum(np.asarray(windows, np.int64) * self.window, self.total)
        c = np.minimum(np.floor(self.time(goal)[:, None] * self.w + 0.5).astype(np.int64), self.t)
        rows, last_queue = np.arange(len(goal)), len(self.t) - 1
        while True:
            due = np.where(c < self.t, (c + 0.5) / self.w, np.inf)
            done = np.where(c > 0, (c - 0.5) / self.w, -np.inf)
            nxt = due.argmin(1)
            last = last_queue - done[:, ::-1].argmax(1)
            a, b = due[rows, nxt], done[rows, last]
            short = goal - c.sum(1)
            swap = (short == 0) & ((a < b) | (a == b) & (nxt < last))
            add, drop = (short > 0) | swap, (short < 0) | swap
            if not (add | drop).any():
                return c
            c[rows[add], nxt[add]] += 1
            c[rows[drop], last[drop]] -= 1


def layout(sched: Schedule, queue: np.ndarray, begin: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
    """Pieces of documents that lie in their queues from ``begin`` on.

    Returns doc (index), start, length, sequence_id and offset of each piece.
    """
    w, slack = sched.w[queue], len(sched.t) / sched.window + 2
    lo = np.maximum(0, np.floor(sched.tokens((begin + 0.5) / w) / sched.window - slack)).astype(np.int64)
    hi = np.ceil(sched.tokens((begin + length - 0.5) / w) / sched.window + slack).astype(np.int64)
    n = hi - lo
    doc = np.repeat(np.arange(len(queue)), n)
    win = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + lo[doc]
    need, at = np.unique(np.concatenate([win, win + 1]), return_inverse=True)
    c = sched.served(need)
    first, after = c[at[:len(win)]], c[at[len(win):]]
    q = queue[doc]
    turn = after - first
    before = np.cumsum(turn, 1) - turn
    rows = np.arange(len(win))
    a = np.maximum(first[rows, q], begin[doc])
    b = np.minimum(after[rows, q], begin[doc] + length[doc])
    keep = b > a
    return {k: v[keep] for k, v in {
        "doc": doc, "start": a - begin[doc], "length": b - a, "sequence_id": win,
        "offset": before[rows, q] + a - first[rows, q]}.items()}


def encode(docs: DataFrame, path: str, keep: tuple[str, ...], end_id: int) -> DataFrame:
    """``keep``, part, begin (in its queue, within the part), doc_tokens and ids of each row."""
    src = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    q = keep.index("source")

    def run(batches):
        part, filled = TaskContext.get().partitionId(), {}
        for b in batches:
            ids, width = tokens.ids_batch(path, b.column(b.num_columns - 1))
            end = np.array([end_id], f"<u{width}").tobytes()
            ids = [x + end for x in ids]
            n = [len(x) // width for x in ids]
            begin = []
            for s, k in zip(b.column(q).to_pylist(), n):
                begin.append(filled.get(s, 0))
                filled[s] = begin[-1] + k
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([part] * len(n), pa.int64()), pa.array(begin, pa.int64()),
                 pa.array(n, pa.int64()), pa.array([width] * len(n), pa.int32()), pa.array(ids, pa.binary())],
                [*keep, "__part", "__begin", "doc_tokens", "__width", "__ids"])

    types = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join(
        [*(f"`{k}` {types[k]}" for k in keep), "__part long", "__begin long", "doc_tokens long", "__width int",
         "__ids binary"]))


def pack(docs: DataFrame, path: str, weights: dict | None = None, window: int = WINDOW, end_id: int = END_ID,
         doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text, source), packed into windows.

    ``weights``: tokens of each source (None: null source) to a window, relative
    to each other; by default each source's share of all tokens, which lets the
    queues run dry together.  Returns doc_id, source, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and with ``with_ids`` the ids themselves.

    A null or empty text is its end token alone; null sources form one queue;
    repeated rows are packed each; an empty table gives no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    keep = ("doc_id", "source")
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    enc = materialize(encode(src, path, keep, end_id), "pack-ids", compression="zstd")
    parts = materialize(enc.groupBy("source", "__part").agg(F.sum("doc_tokens").alias("n")), "pack-parts")
    queues = [(r["source"], r["n"]) for r in
              parts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last())
              .limit(MAX_SOURCES + 1).collect()]
    if len(queues) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; is 'source' the right column?")
    share = [n if weights is None else weights[s] for s, n in queues]
    if any(w <= 0 for w in share):
        raise ValueError("weights must be positive")
    bases = parts.select("source", "__part", (F.sum("n").over(
        Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__base"))
    bases = small(materialize(bases.na.fill(0, ["__base"]), "pack-bases"))
    index = {s: i for i, (s, _) in enumerate(queues)}
    lengths, share = np.array([n for _, n in queues], np.int64), np.array(share, np.float64)
    placed = (enc.alias("e").join(bases.alias("b"), F.col("e.source").eqNullSafe(F.col("b.source"))
                                  & (F.col("e.__part") == F.col("b.__part")))
              .select("e.doc_id", "e.source", "e.doc_tokens", (F.col("__begin") + F.col("__base")).alias("__begin"),
                      "__width", "__ids"))

    def cut(batches):
        sched = Schedule(lengths, share, window)
        step = max(1, min(1000, 200_000 // len(lengths)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                queue = np.array([index[s] for s in b.column(1).to_pylist()])
                n, begin = b.column(2).to_numpy(), b.column(3).to_numpy()
                p = layout(sched, queue, begin, n)
                width = b.column(4)[0].as_py()
                ids = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in b.column(5).to_pylist()]
                sums, body = [], []
                for d, a, k in zip(p["doc"].tolist(), (4 * p["start"]).tolist(), (4 * p["length"]).tolist()):
                    piece = ids[d][a:a + k]
                    sums.append(zlib.crc32(piece))
                    if with_ids:
                        body.append(piece)
                doc = pa.array(p["doc"])
                cols = {"doc_id": b.column(0).take(doc), "source": b.column(1).take(doc),
                        "start": p["start"], "length": p["length"], "ids_crc32": np.array(sums, np.int64),
                        "doc_tokens": n[p["doc"]], "sequence_id": p["sequence_id"], "offset": p["offset"]}
                if with_ids:
                    cols["ids"] = pa.array(body, pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    kind = dict(placed.dtypes)["doc_id"]
    return placed.mapInArrow(cut, f"doc_id {kind}, source string, start long, length long, ids_crc32 long, "
                                  "doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
