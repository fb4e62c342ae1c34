"""Personal data in texts, disguised or not, as spans of source code points.

Base detection reads the text as it stands.  The deobfuscating pass then runs the
text through transducers (look-alike and full-width characters, invisible
characters, spelled digits, "at" / "dot" disguises).  Each transducer rewrites
stretches of the text and keeps, for every stretch, where it came from; the same
detectors read the rewritten text, and a hit is mapped back to the source
characters it covers.  Hits that touch a base span of their kind are that span
again and are left out, so base spans never change.

Edge cases: a null text is empty; an empty text has no spans; the detectors take
linear time on texts of any length (no retries inside a run of digits or
letters); repeated rows are scanned each; other columns pass by unread.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's place in KINDS, end

LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: each '@' is tried once, with all the local part before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def detect(text: str) -> list[Span]:
    """The base spans of a text, by start and then kind."""
    found: list[Span] = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in CARD.finditer(text):
        a, b = m.span()
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((a, 2, b))
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
                  if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    found.sort()
    return found


# Look-alikes of ASCII letters that Unicode normalisation leaves alone (fixed values).
LOOKALIKES = dict(zip(
    "асеорхуіјѕһԁԛԝ"
    "АВСЕНКМОРТХІЈЅ"
    "οανρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
    "ıİɡ‐‑‒–−․。｡",
    "aceopxyijshdqw"
    "ABCEHKMOPTXIJS"
    "oavpABEZHIKMNOPTYX"
    "iIg-----...", strict=True))
# Characters that print nothing (fixed values).
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
# Digits in words, by language (fixed values).
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
DIGITS = {w: str(i) for line in DIGIT_WORDS.values() for i, w in enumerate(line.split())}
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|arroba|arobase|klammeraffe", "dot|punkt|point|punto", "plus|más"
DIGIT_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
LETTER = r"[^\W\d_]"
#: A spelled digit that no letter adjoins; numerals may ("4five39").
SPELLED = re.compile(rf"(?<!{LETTER})(?:{DIGIT_WORD})(?!{LETTER})", re.I)
#: What may part a spelled digit from the digit, spelled or not, beside it.  Dots stay: they part the numbers of an address.
PARTED = re.compile(r" ?\n ?| {1,2}|, ?|-|\. ?")
DIGIT_BEFORE, DIGIT_AFTER = re.compile(r"[0-9]( ?\n ?| {1,2}|, ?|-|\. ?)?\Z"), re.compile(r"( ?\n ?| {1,2}|, ?|-|\. ?)?[0-9]")
OPEN, CLOSE = r"[(\[{<]", r"[)\]}>]"
LOCAL_PART, LABEL = r"[A-Za-z0-9_%+-]", r"[A-Za-z0-9-]"
#: "(at)", "[dot]", ... with optional blanks, between the parts of an address or number.
BRACKETED = re.compile(rf" ?{OPEN} ?(?:(?P<at>{AT_WORDS}|@)|(?P<dot>{DOT_WORDS}|\.)) ?{CLOSE} ?", re.I)
#: "name at host dot tld" in bare words, and "name at host.tld".
BARE = re.compile(
    rf"(?<={LOCAL_PART})(?P<at> (?:{AT_WORDS}) )(?P<host>{LABEL}{{1,63}}(?:(?: (?:{DOT_WORDS}) |\.){LABEL}{{1,63}})+)", re.I)
AT_MARK = re.compile(rf" (?=(?:{AT_WORDS}) )", re.I)
BARE_DOT = re.compile(rf"(?<={LABEL}) (?:{DOT_WORDS}) (?={LABEL})", re.I)
BARE_HOST = re.compile(rf"{LABEL}+(?:\.{LABEL}+)*\.[A-Za-z]{{2,24}}", re.I)
NUMBER_DOT = re.compile(rf"(?<=[0-9]) ?(?: (?:{DOT_WORDS}) ) ?(?=[0-9])", re.I)
PLUS = re.compile(rf"(?<!\w)(?:{PLUS_WORDS}) ?(?=[0-9])", re.I)
BROKEN_AT = re.compile(rf"(?<={LOCAL_PART}) ?@ ?(?={LABEL}+(?:\.| ?{OPEN}))|(?<={LOCAL_PART}) @ (?={LABEL}+\.)")


def _folds(c: str) -> str | None:
    """What a character stands for in an identifier; None where it stands for itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    n = unicodedata.normalize("NFKC", c)
    return n if n != c and n.isascii() and n.isprintable() and n.strip() else None


class Folds(dict):
    """``_folds`` of each character met."""

    def __missing__(self, c: str) -> str | None:
        out = self[c] = None if c.isascii() else _folds(c)
        return out


FOLDS = Folds()


class Mapped:
    """A rewritten text that knows which source characters each of its stretches came from."""

    def __init__(self, text: str):
        self.text = text
        self.at, self.src, self.end, self.same = [0], [0], [len(text)], [True]

    def back(self, a: int, b: int) -> tuple[int, int]:
        """Source span of the rewritten span a..b (b > a)."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        start = self.src[i] + (a - self.at[i]) if self.same[i] else self.src[i]
        end = self.src[j] + (b - self.at[j]) if self.same[j] else self.end[j]
        return start, end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Apply disjoint edits (start, end, new text), in order of start."""
        out = Mapped.__new__(Mapped)
        out.at, out.src, out.end, out.same = [], [], [], []
        parts, n = [], 0

        def keep(a: int, b: int) -> None:
            nonlocal n
            i = bisect_right(self.at, a) - 1
            while a < b:
                stop = min(b, self.at[i + 1]) if i + 1 < len(self.at) else b
                s = self.src[i] + (a - self.at[i]) if self.same[i] else self.src[i]
                e = s + stop - a if self.same[i] else self.end[i]
                add(self.text[a:stop], s, e, self.same[i])
                a, i = stop, i + 1

        def add(new: str, s: int, e: int, same: bool) -> None:
            nonlocal n
            if new:
                out.at.append(n)
                out.src.append(s)
                out.end.append(e)
                out.same.append(same)
                parts.append(new)
                n += len(new)

        last = 0
        for a, b, new in edits:
            keep(last, a)
            if new:
                s, e = self.back(a, b)
                add(new, s, e, False)
            last = b
        keep(last, len(self.text))
        out.text = "".join(parts)
        if not out.at:
            out.at, out.src, out.end, out.same = [0], [0], [0], [False]
        return out


def fold_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    odd = {c for c in set(text) if FOLDS[c] is not None}
    if not odd:
        return []
    return [(m.start(), m.end(), FOLDS[m[0]]) for m in re.finditer("[" + re.escape("".join(sorted(odd))) + "]", text)]


def digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits beside a numeral or another spelled digit become digits; what parts them goes, but for dots."""
    found = list(SPELLED.finditer(text))
    out: list[tuple[int, int, str]] = []
    joined = False  # with the one before
    for m, after in zip(found, [*found[1:], None]):
        a, b = m.span()
        gap = text[b:after.start()] if after else None
        next_joined = after is not None and PARTED.fullmatch(gap) is not None
        left = None if joined else DIGIT_BEFORE.search(text, max(0, a - 4), a)
        right = None if next_joined else DIGIT_AFTER.match(text, b)
        if joined or next_joined or left or right:
            if left and left[1] and "." not in left[1]:
                out.append((a - len(left[1]), a, ""))
            out.append((a, b, DIGITS[m[0].lower()]))
            if next_joined and "." not in gap:
                out.append((b, after.start(), ""))
            elif right and right[1] and "." not in right[1]:
                out.append((b, b + len(right[1]), ""))
        joined = next_joined
    # two words beside one numeral may both want the blank between
    return [e for e, before in zip(out, [(0, 0, ""), *out]) if e[0] >= before[1]]


def lone_digit_edits(text: str) -> list[tuple[int, int, str]]:
    """A single spelled digit between "dot" words of a number, as in "10 dot zero dot 0 dot one"."""
    return [(m.start(), m.end(), DIGITS[m[0].lower()]) for m in LONE.finditer(text)]


LONE = re.compile(rf"(?<!{LETTER})(?:{DIGIT_WORD})(?= (?:{DOT_WORDS}) )|(?:(?<= dot )|(?<= punkt )|(?<= point )|(?<= punto ))"
                  rf"(?:{DIGIT_WORD})(?!{LETTER})", re.I)


def disguise_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m["at"] else ".") for m in BRACKETED.finditer(text)]


def bare_edits(text: str) -> list[tuple[int, int, str]]:
    out, end = [], 0
    for at in AT_MARK.finditer(text):
        m = BARE.match(text, at.start()) if at.start() >= end else None
        if m:
            end = m.end()
            host = BARE_DOT.sub(".", m["host"])
            last = host.rpartition(".")[2]
            if BARE_HOST.match(host) and (last.islower() or last.isupper()):
                out.append((m.start("at"), m.end("at"), "@"))
                out += [(d.start(), d.end(), ".") for d in BARE_DOT.finditer(text, m.start("host"), m.end("host"))]
    return out


def joined_dots(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(text)]


def host_dots(text: str) -> list[tuple[int, int, str]]:
    """Bare dot words after a plain "@": "name@host dot tld"."""
    out = []
    for m in AT_HOST.finditer(text):
        out += [(d.start(), d.end(), ".") for d in BARE_DOT.finditer(text, m.start(1), m.end(1))]
    return out


AT_HOST = re.compile(rf"(?<={LOCAL_PART})@({LABEL}{{1,63}}(?:(?: (?:{DOT_WORDS}) |\.){LABEL}{{1,63}})+)", re.I)


def plus_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "+") for m in PLUS.finditer(text)]


def broken_at(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@") for m in BROKEN_AT.finditer(text) if len(m[0]) > 1]


class Clues:
    """What of a text without look-alikes any edit of a transducer needs; read once for all of them."""

    #: ASCII letters and the bytes of other characters; all else parts words.
    PARTS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
    SPELT = frozenset(w.encode() for w in DIGITS)

    def __init__(self, text: str):
        self.text, self.low = text, text.lower()
        self.dot, self.at = (any(f" {w} " in self.low for w in words.split("|")) for words in (DOT_WORDS, AT_WORDS))
        self.plus = any(w in self.low for w in PLUS_WORDS.split("|"))
        self.sign = "@" in text
        self.spaced = " @" in text or "@ " in text
        self.brackets = any(c in text for c in "([{<") and any(c in text for c in ")]}>")

    @property
    def digit(self) -> bool:
        """Whether a run of letters is a spelled digit."""
        low = self.low
        if not low.isascii():
            for c in set(low):
                if not c.isascii() and (c.isdecimal() or not c.isalnum()):
                    low = low.replace(c, " ")
        return not self.SPELT.isdisjoint(low.encode().translate(self.PARTS).split())


#: The cascade after folding, each reading what the one before has written, and what of a text it needs to do anything.
TRANSDUCERS = (
    (digit_edits, lambda c: c.digit),
    (lone_digit_edits, lambda c: c.dot and c.digit),
    (disguise_edits, lambda c: c.brackets),
    (joined_dots, lambda c: c.dot),
    (broken_at, lambda c: c.spaced),
    (bare_edits, lambda c: c.at),
    (host_dots, lambda c: c.sign and c.dot),
    (plus_edits, lambda c: c.plus),
)


def disguised(text: str, base: list[Span], guarded: bool = True) -> list[Span]:
    """Spans that only the normal form shows, in source characters.  ``guarded``: ask for a transducer's clue before it runs."""
    m = Mapped(text)
    if edits := fold_edits(text):
        m = m.rewrite(edits)
    clues = Clues(m.text)
    for transduce, needs in TRANSDUCERS:
        if (not guarded or needs(clues)) and (edits := transduce(m.text)):
            m = m.rewrite(edits)
            clues = Clues(m.text)
    if m.text == text:
        return []
    taken: dict[int, list[tuple[int, int]]] = {}
    for a, k, b in base:
        taken.setdefault(k, []).append((a, b))
    out = []
    for a, k, b in detect(m.text):
        s, e = m.back(a, b)
        if not any(x <= s and e <= y for x, y in taken.get(k, ())):
            out.append((s, k, e))
    return out


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_email .. n_phone (base spans), base_sha256, spans (all) and n_added of every row."""
    src = df.select(*keep, text)

    def scan(batches):
        for b in batches:
            counts, sha, spans, added = [], [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                base = detect(t or "")
                more = disguised(t, base) if t else []
                counts.append([sum(s[1] == k for s in base) for k in range(4)])
                sha.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spans.append(spell(sorted(base + more)))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)),
                 pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                [*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    types = dict(src.dtypes)
    return src.mapInArrow(scan, ", ".join([*(f"`{k}` {types[k]}" for k in keep), *(f"n_{k} long" for k in KINDS),
                                           "base_sha256 string, spans string, n_added long"]))
