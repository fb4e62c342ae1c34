"""Conversation structure repair by depth-first branch-and-bound.

A conversation is sound when its roles' initials read ``(s?(ua)+)?``.  Rows are kept,
given another role, deleted or inserted at the costs below; the cheapest edits win, and
of equally cheap ones those whose initials (K, R, D, I) are least in ASCII order.

The search takes the rows in order.  A node is a place in the rows and what the roles so
far have come to; its children are the edits in order of their initials, so that prefixes
are met in ASCII order.  An explicit stack holds the open nodes.  A node goes when its
cost and the suffix lower bound exceed the incumbent's cost, when they equal it and an
incumbent with a lesser audit is known, or when the dominance table has an earlier prefix
to the same node that cost no more.  The bounds come from a pass over the rows from
the end that leaves ties open; a dive along them gives the first incumbent.

Conversations are sorted streams, so a task holds of the one at hand a few bytes a row
and never its texts: one pass over narrow rows finds the edits, a second one writes the
repaired texts into the digest.  A digest can only be fed in order, so a conversation,
however long, is the stream of one task.

Edge cases: a null role or text is one space; rows of one turn stand in order of role
and the md5 of their text, rows without a turn come first; rows with a null id are one
conversation; a role without an initial fits nowhere; repeated rows are duplicates (the
first is not); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: What the roles so far have come to: nothing, a system row, ... user, ... assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after an added or changed row, and the role that row gets.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: State after a kept row, by state and initial; -1 where it doesn't fit.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
INITIALS = "sua"
#: A row's code: the place of its initial in INITIALS (3: another), 4 more where it is truncated; MUST_GO for blank and duplicate rows.
MUST_GO = 8
NEVER = 1 << 40
LEGAL = {"su", "ua", "au"}


def row_code(role: str, must_go: bool, truncated: bool) -> int:
    if must_go:
        return MUST_GO
    return (INITIALS.find(role[:1]) if role else -1) % 4 + 4 * truncated


def _moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, state after) of a row's own edits, in ASCII order of initials."""
    out = [("D", DELETE, state)]
    if code != MUST_GO:
        extra = TRUNCATED if code >= 4 else 0
        fit = KEPT[state].get(INITIALS[code % 4]) if code % 4 < 3 else None
        if fit is not None:
            out.append(("K", extra, fit))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


MOVES = [[_moves(code, state) for state in range(4)] for code in range(MUST_GO + 1)]


def _inserted(cost: list[int]) -> tuple[int, ...]:
    """Least costs by state when rows may be inserted first."""
    user = min(cost[USER], INSERT + cost[ASSISTANT])
    return (min(cost[START], INSERT + user), min(cost[SYSTEM], INSERT + user), user, min(cost[ASSISTANT], INSERT + user))


LAST = _inserted([0, NEVER, NEVER, 0])


class Bounds:
    """Suffix lower bounds: the least cost from each place and state, as an offset a place and one of a few patterns."""

    def __init__(self, codes: bytes):
        self.offset, self.pattern, self.known = array("q", [0]), array("H", [0]), [LAST]
        number, step = {LAST: 0}, {}
        at, offset = 0, 0
        for code in reversed(codes):
            if (at, code) not in step:
                after = self.known[at]
                best = _inserted([min(c + after[q] for _, c, q in MOVES[code][s]) for s in range(4)])
                low = min(best)
                best = tuple(b - low for b in best)
                if best not in number:
                    number[best] = len(self.known)
                    self.known.append(best)
                step[at, code] = number[best], low
            at, low = step[at, code]
            offset += low
            self.offset.append(offset)
            self.pattern.append(at)

    def at(self, i: int, state: int) -> int:
        """Bound at place ``i``, counted from the end."""
        return self.offset[i] + self.known[self.pattern[i]][state]


class NoBounds:
    """Bounds that say nothing; the search is right with any that never exceed the true cost."""

    def __init__(self, codes: bytes):
        pass

    def at(self, i: int, state: int) -> int:
        return 0


def children(codes: bytes, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, place after, state after) in ASCII order of initials."""
    own = [(x, c, i + 1, s) for x, c, s in MOVES[codes[i]][state]] if i < len(codes) else []
    return sorted([*own, ("I", INSERT, i, NEXT[state])])


def dive(codes: bytes, bounds) -> int:
    """Cost of a sound conversation: the child with the least bound, until the end; deleting all is always sound."""
    i = state = cost = 0
    while i < len(codes) or state in (SYSTEM, USER):
        _, c, i, state = min(children(codes, i, state), key=lambda x: (x[1] + bounds.at(len(codes) - x[2], x[3]), x[2] == i, x[0]))
        cost += c
        if cost > DELETE * len(codes):
            break
    return min(cost, DELETE * len(codes))


def search(codes: bytes, bounds_of=Bounds) -> tuple[int, str]:
    """Least cost and, of that cost, the least audit."""
    n, bounds = len(codes), bounds_of(codes)
    best, audit = dive(codes, bounds), None
    seen = array("q", [NEVER]) * (4 * (n + 1))
    path: list[str] = []
    stack = [(0, START, 0, 0, "")]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        low = cost + bounds.at(n - i, state)
        if low > best or low == best and audit is not None or cost >= seen[4 * i + state]:
            continue
        seen[4 * i + state] = cost
        del path[max(depth - 1, 0):]
        if letter:
            path.append(letter)
        if i == n and state in (START, ASSISTANT):
            best, audit = cost, "".join(path)
            continue
        for x, c, j, s in reversed(children(codes, i, state)):
            stack.append((j, s, cost + c, depth + 1, x))
    return best, audit


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and alive of the damaged rows; a dropped row stays with alive false, for its id."""
    word = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn, role, text)]
    fate = F.crc32(F.concat(word[0], F.lit(":"), word[1])) % 20
    hurt = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), fate.alias("fate"), word[2].alias("role"), word[3].alias("text"))
    return hurt.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") != 0).alias("alive"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def by_conversation(rows: DataFrame, *order: Column) -> DataFrame:
    """Sorted streams: each conversation's rows one after another, in one partition."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]


STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Conversation:
    """What one pass over a conversation's rows gathers."""

    def __init__(self):
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        must_go = blank or again
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not must_go
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL
        self.before = role[:1]
        self.codes.append(row_code(role, must_go, cut))

    def stats(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, audit = search(bytes(self.codes))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def edits(rows: DataFrame) -> DataFrame:
    """conv_id and STATS of every conversation of (conv_id, turn, role, hash, blank, cut, alive)."""
    # partitioned by conversation already, so this window costs a sort and no shuffle
    again = F.row_number().over(_window("conv_id", "role", "hash", "alive").orderBy(F.col("turn").asc_nulls_first())) > 1
    flagged = rows.repartition("conv_id").select("conv_id", "turn", "role", "hash", "blank", again.alias("again"), "cut", "alive")
    src = flagged.sortWithinPartitions("conv_id", *in_order(), "again").select("conv_id", "turn", "role", "blank", "again", "cut", "alive")
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        now, talk, out = None, None, []
        for b in batches:
            at = b.schema.field("conv_id").type
            for key, turn, role, blank, again, cut, alive in zip(*(c.to_pylist() for c in b.columns)):
                if talk is None or key != now:
                    if talk is not None:
                        out.append((now, *talk.stats()))
                    now, talk = key, Conversation()
                if alive:
                    talk.add(turn, role, blank, again, cut)
            if len(out) >= 1000:
                yield frame(out, at)
                out = []
        if talk is not None:
            yield frame([*out, (now, *talk.stats())], at)

    def frame(out, at):
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], at), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.string())],
                                          ["conv_id", *(x.split()[0] for x in STATS.split(", "))])

    return src.mapInArrow(run, f"conv_id {kind}, {STATS}")


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


class Writer:
    """Feeds the repaired rows of one conversation to a digest, as the audit says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.some, self.sha = audit, 0, START, False, hashlib.sha256()

    def line(self, role: str, text: str, state: int) -> None:
        self.sha.update(("\n" * self.some + role + ":" + text).encode())
        self.some, self.state = True, state

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.line(ROLE[self.state], "", NEXT[self.state])

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.line(role, text, KEPT[self.state][role[0]])
        elif letter == "R":
            self.line(ROLE[self.state], text, NEXT[self.state])

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` with repaired_sha256, from rows (conv_id, turn, role, text, hash)."""
    names = [x.split()[0] for x in STATS.split(", ")]
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "hash", "text", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in STATS.split(", ")))
    turn = dict(rows.dtypes)["turn"]
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(turn).alias("turn"), F.lit("").alias("role"),
                          F.lit(None).cast("binary").alias("hash"), F.lit("").alias("text"), *names)
    src = by_conversation(heads.unionByName(texts), F.col("kind"), *in_order()).select("conv_id", "kind", "role", "text", *names)
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        head, writer, out = None, None, []
        for b in batches:
            schema = b.schema
            stats = [c.to_pylist() for c in (b.column(0), *b.columns[4:])]
            for i, (k, role, text) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))):
                if k:
                    writer.row(role, text)
                else:
                    if writer:
                        out.append((*head, writer.digest()))
                    head = [c[i] for c in stats]
                    writer = Writer(head[-1])
            if len(out) >= 1000:
                yield frame(out, schema)
                out = []
        if writer:
            yield frame([*out, (*head, writer.digest())], schema)

    def frame(out, schema):
        cols = list(zip(*out))
        kinds = [schema.field(0).type, *(schema.field(n).type for n in names), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["conv_id", *names, "repaired_sha256"])

    return src.mapInArrow(run, f"conv_id {kind}, {STATS}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of
    (conv_id, turn, role, text) and optionally alive: where false, a row only says that its conversation exists."""
    if "alive" not in rows.columns:
        rows = rows.withColumn("alive", F.lit(True))
    full = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "alive") \
        .withColumn("hash", F.unhex(F.md5("text")))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = full.select("conv_id", "turn", "role", "hash", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(*ENDS)).alias("cut"), "alive")
    audits = materialize(edits(narrow), "conversation-edits")
    return repaired(full.where("alive"), audits)
