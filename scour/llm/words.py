"""Word hashes of whole Arrow columns, straight from their UTF-8 bytes.

Words are maximal runs of bytes other than space and the ASCII controls 9-13.  A
word's hash is a polynomial of its bytes modulo 2^64, from prefix sums over the
text, mixed with its length; a stretch of words is hashed the same way from the
hashes of its words.  Equal stretches have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
#: Bytes hashed in one go.
CHUNK = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """STEP and its inverse to the powers 0, 1, ..., as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            both = []
            for base in (STEP, BACK):
                p = np.full(n + 1, base, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p))
            if n > 2 * CHUNK:
                return both[0], both[1]  # not kept
            self.up, self.down = both
        return self.up, self.down


POWERS = Powers()


class Stretches:
    """Hashes of any stretches of a sequence of integers."""

    def __init__(self, x: np.ndarray, powers: Powers | None = None):
        up, self.down = (powers or POWERS).upto(len(x))
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[:len(x)], out=self.sums[1:])

    def at(self, a: np.ndarray, n) -> np.ndarray:
        """Hashes of the n items from each of the places a."""
        return mix((self.sums[a + n] - self.sums[a]) * self.down[a] + np.asarray(n).astype(np.uint64))


def words_of(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of each word, and the words of each row; ``rows``: first byte of each row, and the end."""
    blank = BLANK[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = blank[:-1]
    edge[rows] = True
    begin = np.flatnonzero(edge[:-1] & ~blank)
    edge[:-1] = blank
    edge[rows] = True
    end = np.flatnonzero(edge[1:] & ~blank) + 1
    return begin, end - begin, np.diff(np.searchsorted(begin, rows))


def hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the words of each row."""
    begin, n, sizes = words_of(data, rows)
    return Stretches(data.astype(np.uint64) + np.uint64(1)).at(begin, n), sizes


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text, a chunk at a time; chunks end at blanks."""
    out, a = [], 0
    while a < len(data):
        z = min(a + CHUNK, len(data))
        while z < len(data):
            gaps = np.flatnonzero(BLANK[data[a:z]])
            if len(gaps):
                z = a + int(gaps[-1]) + 1
                break
            z = min(z + CHUNK, len(data))
        out.append(hashes(data[a:z], np.array([0, z - a]))[0])
        a = z
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def chunks(texts: pa.Array, fold: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words of each row, word hashes end to end) over runs of rows; nulls have no words.

    ``fold`` lower-cases A-Z.
    """
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1, i + 1)
        part = data[at[i]:at[j]]
        part = FOLD[part] if fold else part
        if j == i + 1 and len(part) > CHUNK:
            h = _long(part)
            yield i, np.array([len(h)]), h
        else:
            h, sizes = hashes(part, at[i:j + 1] - at[i])
            yield i, sizes, h
        i = j


def text_hashes(text: str | None) -> np.ndarray:
    """Word hashes of one text."""
    return np.concatenate([h for _, _, h in chunks(pa.array([text], pa.string()))])
