"""Token counts and token ids of whole texts, by a public tokenizer file.

Texts travel as Arrow batches, worked on in chunks of about ``CHUNK_BYTES`` (batches
balanced by bytes).  A text is split at *safe boundaries*: a single space between
two non-blank characters, across which neither the pre-tokenizer nor the
normaliser of the supported files looks.  Every piece keeps its leading space, so
the ids of a text are the concatenation of the ids of its pieces.  Arrow splits a
chunk and numbers its distinct pieces; each worker keeps the encodings of pieces
it has met in a bounded store and sends only unseen ones to the tokenizer, joined
into runs of about ``RUN_CHARS`` characters (so a long text fills several runs);
ids or offsets tell the pieces of a run apart.  Other white space next to a space (two
spaces, a tab after a space, ...) stays inside its piece, so it keeps together only the
two words beside it, however long the text.

Edge cases: a null or empty text has no ids; special strings inside a text get
the tokenizer file's default treatment; nothing is truncated or padded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text that is split and numbered at once.
CHUNK_BYTES = 32 << 20
#: Characters of unseen pieces that one entry of an encode batch holds.
RUN_CHARS = 1 << 12
#: How a byte-level vocabulary writes the space.
SPACE = "\u0120"
#: Pieces a worker remembers at most; then the older half makes room.
MAX_PIECES = 1_500_000
#: White space, Unicode's included.
BLANK = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space that is not a safe boundary: next to other white space or at an end.
UNSAFE = rf"\A | \z| {BLANK}|{BLANK} "
SPACES = "\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SAFE = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")


class Encoder:
    """Piece-wise encoder around one ``tokenizers.Tokenizer``."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.max_pieces = max_pieces
        self.first_id = self._first_ids()

    def _first_ids(self) -> np.ndarray | None:
        """For a byte-level vocabulary that keeps spaces: which ids begin with one, so mark the start of a piece."""
        vocab = self.tok.get_vocab(with_added_tokens=True)
        if SPACE not in vocab:
            return None
        first = np.zeros(max(vocab.values()) + 1, bool)
        first[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True
        return first

    def cuts(self, run: list[str], enc, ids: np.ndarray) -> np.ndarray:
        """Where the ids of each piece of a run end."""
        if self.first_id is not None:
            starts = np.flatnonzero(self.first_id[ids])
            if len(starts) == len(run) and starts[0] == 0:
                return np.append(starts[1:], len(ids))
        starts = np.array(enc.offsets, np.int64).reshape(-1, 2)[:, 0]
        ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1)
        return np.searchsorted(starts, ends, "left")

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def pieces(self, unseen: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Encode pieces that follow a space, joined into runs: (run, its ids, end of each piece in them)."""
        runs, run, n = [], [], 0
        for p in unseen:
            run.append(p)
            n += len(p) + 1
            if n >= RUN_CHARS or p[-1:].isspace():  # what ends in white space has nothing behind it
                runs.append(run)
                run, n = [], 0
        if run:
            runs.append(run)
        for lo in range(0, len(runs), 16):
            part = runs[lo:lo + 16]
            texts = [" " + " ".join(run) for run in part]
            for run, enc in zip(part, self.tok.encode_batch(texts, add_special_tokens=False)):
                ids = np.array(enc.ids, self.dtype)
                yield run, ids, self.cuts(run, enc, ids)


def _lengths(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    return np.diff(ends, prepend=0).tolist()


def _bytes(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, cuts = ids.tobytes(), (ends * ids.itemsize).tolist()
    return [raw[a:b] for a, b in zip([0, *cuts], cuts)]


def _remember(seen: dict, limit: int) -> None:
    if len(seen) > limit:
        for k in list(seen)[: len(seen) // 2]:
            del seen[k]


_STATE: dict = {}


def state(path: str, kind: str) -> tuple[Encoder, dict]:
    """One encoder and its store per worker process, file and kind of value."""
    if (path, kind) not in _STATE:
        _STATE[path, kind] = (Encoder(path), {})
    return _STATE[path, kind]


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of consecutive texts of about CHUNK_BYTES together."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def split(texts: pa.Array) -> pa.Array:
    """The pieces of each text: cut at every safe boundary."""
    unsafe = pc.match_substring_regex(texts, UNSAFE)
    if not pc.any(unsafe).as_py():
        return pc.split_pattern(texts, " ")
    odd = texts.filter(unsafe).to_pylist()
    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if not pc.any(pc.match_substring(texts, c)).as_py())
    plain = pc.replace_substring(texts, " ", mark)
    marked = pa.array([SAFE.sub(mark, t) for t in odd], texts.type)
    return pc.split_pattern(pc.replace_with_mask(plain, unsafe, marked), mark)


def pieces(enc: Encoder, seen: dict, texts: pa.Array, values) -> tuple[list, np.ndarray, np.ndarray]:
    """Values of the distinct pieces, the piece numbers of all texts in a row, and where each text's begin (and the end).

    The first piece of a text has no space before it and gets a value of its own.
    """
    _remember(seen, enc.max_pieces)
    split_up = split(pc.fill_null(texts, ""))
    at = split_up.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    flat = split_up.flatten()
    names = pc.list_element(split_up, 0).to_pylist()
    numbered = flat.dictionary_encode()
    rest, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy().astype(np.int64)
    for run, ids, ends in enc.pieces([p for p in rest if p not in seen]):
        seen.update(zip(run, values(ids, ends)))
    first: dict[str, int] = {}
    number[at[:-1]] = [len(rest) + first.setdefault(t, len(first)) for t in names]
    own = []
    for lo in range(0, len(first), 1024):
        for ids in enc.whole(list(first)[lo:lo + 1024]):
            own += values(np.array(ids, enc.dtype), np.array([len(ids)]))
    return [seen[p] for p in rest] + own, number, at


def count_batch(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text."""
    enc, seen = state(path, "count")
    out = [np.zeros(0, np.int64)]
    for part in chunks(texts):
        value, number, at = pieces(enc, seen, part, _lengths)
        out.append(np.add.reduceat(np.array(value, np.int64)[number], at[:-1]))
    return np.concatenate(out)


def ids_batch(path: str, texts: pa.Array) -> tuple[list[bytes], int]:
    """Little-endian ids of each text, and the bytes of one id."""
    enc, seen = state(path, "ids")
    out: list[bytes] = []
    for part in chunks(texts):
        value, number, at = pieces(enc, seen, part, _bytes)
        joined = pa.array(value, pa.large_binary()).take(pa.array(number))
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int64)[joined.offset:joined.offset + len(joined) + 1][at].tolist()
        data = memoryview(data) if data is not None else memoryview(b"")
        out += [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
    return out, enc.dtype.itemsize


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 2048,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes (UTF-8), n_tokens and over_limit of every row.

    Only lengths leave the Python workers.  A null text counts 0 bytes and 0
    tokens; repeated rows are counted each; other columns are not read.
    """
    src = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def count(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pc.cast(pc.binary_length(texts), pa.int64()), pa.array(count_batch(path, texts), pa.int64())],
                [*keep, "n_bytes", "n_tokens"])

    types = dict(src.dtypes)
    out = src.mapInArrow(count, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "n_bytes long", "n_tokens long"]))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
