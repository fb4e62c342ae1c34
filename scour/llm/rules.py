"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in SQL expression over the whole text; the rules of the
table become comparisons of measures with bounds in the same projection.  No user
function runs, nothing shuffles, and the plan is a scan and a projection.

Edge cases: a null or empty text has no words and fails the base rule; a measure
that divides by zero words or lines is 0; repeated rows are judged each; an empty
table gives no rows; columns of the input that bear a measure's name do no harm
(only the text column is read; helper columns start with two underscores).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"
BULLET = r"^\s*[-*\x{2022}\x{2023}\x{b7}]"
ELLIPSIS = r"(?:\.\.\.|\x{2026})\s*$"
WINDOW = 5
#: Common words of the four languages, lower case (fixed values).
STOP_WORDS = (
    "the and of to in is on that was for with as are by this from it be at or a "
    "der die das und von den nicht ein mit sich des auf dem zu ist im als auch für "
    "le la les de et des du un une en que qui dans pour est au par sur "
    "el los las y del que en una con para no su se al lo").split()


class Rule(NamedTuple):
    """Documents of ``least`` words and more are rejected when ``measure`` leaves low..high."""

    name: str
    measure: str
    low: float | None
    high: float | None
    least: int = 0


#: The rules beside the base rule.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols", "symbols_per_word", None, 0.25),
    Rule("shouts", "shouts_per_word", None, 0.5),
    Rule("stop_words", "stop_word_ratio", 0.01, None, least=50),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9, least=20),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.5, least=20),
)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in a WINDOW-word window found twice or more among ``words``."""

    def starts(h: Column) -> Column:
        """Positions of the windows that have an equal one, in order."""
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            def alike(x: Column, k: Column) -> Column:
                return (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(F.filter(s, alike), lambda x: x["i"]))

        return bind(pairs, twins)

    def covered(p: Column) -> Column:
        none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(p, none, lambda a, x: F.struct(
            x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                             lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
        return F.when(F.size(w) > WINDOW, bind(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), covered(starts(h))).otherwise(F.lit(0).cast("long"))))

    return F.coalesce(bind(words, count), F.lit(0).cast("long"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def arrays(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the text, its words and its lines that hold a word, each worked out once for all measures."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (df.withColumn("__text", t)
            .withColumn("__words", F.filter(F.split("__text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
            .withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD))))


def measures() -> dict[str, Column]:
    """Every measure by name, over the columns of ``arrays``; counts are long, ratios double."""
    text, words, lines = F.col("__text"), F.col("__words"), F.col("__lines")
    n_words, n_lines = F.size(words).cast("long"), F.size(lines).cast("long")
    word_chars = F.char_length(text).cast("long") - count(text, r"[\x20\x09-\x0D]")
    symbols, shouts = count(text, f"[{SYMBOLS}]"), count(text, f"[{SHOUTS}]")
    dup_lines = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    stops = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
    bullets = F.size(F.filter(lines, lambda x: x.rlike(BULLET)))
    ellipses = F.size(F.filter(lines, lambda x: x.rlike(ELLIPSIS)))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words(words),
        "mean_word_chars": ratio(word_chars, n_words), "symbols_per_word": ratio(symbols, n_words),
        "shouts_per_word": ratio(shouts, n_words), "stop_word_ratio": ratio(stops, n_words),
        "dup_line_ratio": ratio(dup_lines, n_lines), "bullet_line_ratio": ratio(bullets, n_lines),
        "ellipsis_line_ratio": ratio(ellipses, n_lines),
    }


def base_failed(m: dict[str, Column]) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def breaks(rule: Rule, m: dict[str, Column]) -> Column:
    x = m[rule.measure]
    out = F.lit(False)
    if rule.low is not None:
        out = out | (x < rule.low)
    if rule.high is not None:
        out = out | (x > rule.high)
    return out & (m["n_words"] >= rule.least) if rule.least else out


def judge(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns, the base counts, base_failed, kept and broken (names of the broken rules) of every row."""
    m = measures()
    used = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            *dict.fromkeys(r.measure for r in rules if not r.measure.startswith("n_"))]
    wide = arrays(df.select(*keep, text), text).select(*keep, *(m[k].alias(f"__{k}") for k in used))
    at = {k: F.col(f"__{k}") for k in used}
    broken = F.filter(F.array(*(F.when(breaks(r, at), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull()) \
        if rules else F.array().cast("array<string>")
    failed = base_failed(at)
    fine = reduce(lambda a, r: a & ~breaks(r, at), rules, ~failed)
    return wide.select(*keep, *(at[k].alias(k) for k in used[:5]), failed.alias("base_failed"), fine.alias("kept"),
                       broken.alias("broken"))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass, with its own columns."""
    m = measures()
    fine = reduce(lambda a, r: a & ~breaks(r, m), rules, ~base_failed(m))
    src = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text).alias("text"))
    return arrays(src, "text").where(fine).select("row.*")
