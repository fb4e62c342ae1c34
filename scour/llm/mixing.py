"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source with target ``T`` words and ``S`` words of its own gives ``T // S`` complete
epochs and then a fraction: its documents get exponential keys ``-ln(u) / w``
(``u`` uniform from a hash of the id, ``w`` the document's quality weight) and are
taken in order of key until the rest of the budget is filled.  Equal runs agree,
as nothing depends on partitions.

No source is sorted or gathered.  Keys are cut into ``BINS`` bins; sizes per
(source, bin) are pre-aggregated and prefix-summed, which names the one bin where
the budget runs out; that bin is cut again, whatever share of a source it holds, until
at most ``EDGE`` documents are left to be ranked, which names the last key.  The decision
on a document is then a comparison of its key with its source's last key.

Edge cases: a null text has size 0, a null source is a source of its own (ordered
last), documents of size 0 take 0 words, repeated rows share a key and are
treated alike (the last ones share what is left of the budget), an empty table
gives no rows, a mixture without words has targets 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, small, word_count

WEIGHTS = (5, 2, 1)
#: A target never exceeds so many times its source.
EPOCHS = 3
BINS = 4096
#: Rows of the last bin that are ranked one by one.
EDGE = 100_000
NOISE = "#*$%&|<>!"


def quality_weight(text: Column) -> Column:
    """1 for plain words, less the more symbols there are for a word."""
    n = F.coalesce(F.regexp_count(text, F.lit(f"[{NOISE}]")), F.lit(0))
    return F.lit(1.0) / (F.lit(1.0) + n / F.greatest(word_count(text), F.lit(1)))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of seed and id; a null id counts as the text "null"."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def keyed(docs: DataFrame, doc_id: str, text: str, source: str, weight: Column | None, seed: int, row: bool = False) -> DataFrame:
    """(source, __id, __size, __key: ascending, taken first) of every row, and the row itself as the struct __row."""
    w = quality_weight(F.col(text)) if weight is None else weight
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")] * row
    return docs.select(*whole, F.col(doc_id).alias("__id"), F.col(source).alias("source"), word_count(F.col(text)).alias("__size"),
                       (-F.log(uniform(F.col(doc_id), seed)) / w).alias("__key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Target of every source from (source, source_size): all words shared by weight, each within its cap.

    Weights repeat over the sources in order of name.  Capped sources give their
    excess to the others by weight: with sources ordered by cap / weight, the
    first share per weight that caps no later source is the level of the rest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pos = (F.row_number().over(order) - 1) % len(weights)
    w = sizes.withColumn("w", F.element_at(F.array(*(F.lit(x) for x in weights)), pos + 1)) \
        .withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everyone = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ((F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
             / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    w = w.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everyone)["level"]
    return w.select("source", "source_size", F.least(fits * F.col("w"), F.col("cap").cast("double")).alias("target"))


def summed(rows: DataFrame) -> DataFrame:
    """(source, __bin, n, rows, low, high): words, rows and range of keys of each bin."""
    return rows.groupBy("source", "__bin").agg(F.sum("__size").alias("n"), F.count("*").alias("rows"), F.min("__key").alias("low"),
                                               F.max("__key").alias("high"))


def ending(bins: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, rows, low, high, left): the bin in which each source's budget (source, left) runs out, and what is left of it there."""
    ends = bins.withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("__bin")))
    return materialize(ends.alias("e").join(small(budgets).alias("a"), F.col("e.source").eqNullSafe(F.col("a.source")))
                       .where("e.end - e.n < a.left AND e.end >= a.left")
                       .select("e.source", "rows", "low", "high", (F.col("a.left") - F.col("e.end") + F.col("e.n")).alias("left")), "mix-edges")


def plan(table: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """One row per source: target, epochs, budget, and the last key with the words left for each row that has it.

    ``table`` is a written (source, __id, __size, __key).  The key at which a budget runs out is closed in on: its
    source's words are summed in ``BINS`` bins of the keys, then in as many bins of the one bin in which the budget
    ends, until that holds ``EDGE`` rows at most or a single key.
    """
    first = F.least(F.floor((1 - F.exp(-F.col("__key"))) * BINS), F.lit(BINS - 1)).cast("int")
    bins = materialize(summed(table.withColumn("__bin", first)), "mix-bins")
    aim = targets(bins.groupBy("source").agg(F.sum("n").alias("source_size")), weights, epochs) \
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))) \
        .withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5))
    aim = materialize(aim, "mix-targets")
    same = F.col("e.source").eqNullSafe(F.col("a.source"))
    edge = ending(bins, aim.select("source", F.col("budget").alias("left")))
    while edge.where((F.col("rows") > EDGE) & (F.col("low") < F.col("high"))).limit(1).count():
        inside = (table.alias("e").join(small(edge).alias("a"), same & F.col("e.__key").between(F.col("a.low"), F.col("a.high")))
                  .select("e.source", "__size", "__key", F.when(F.col("low") < F.col("high"), F.least(F.floor(
                          (F.col("__key") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))).otherwise(0).cast("int").alias("__bin")))
        edge = ending(materialize(summed(inside), "mix-bins"), edge.select("source", "left"))
    ties = (table.alias("e").join(small(edge).alias("a"), same & F.col("e.__key").between(F.col("a.low"), F.col("a.high")))
            .groupBy("e.source", "__key", "__id").agg(F.sum("__size").alias("n"), F.count("*").alias("rows"), F.first("left").alias("left")))
    rank = Window.partitionBy("source").orderBy("__key", F.col("__id").asc_nulls_first())
    last = (ties.withColumn("end", F.sum("n").over(rank)).where("end - n < left AND end >= left")
            .select("source", F.col("__key").alias("last_key"), F.col("__id").alias("last_id"),
                    F.col("n").alias("last_words"), (F.col("left") - F.col("end") + F.col("n")).alias("last_left"),
                    F.col("rows").alias("last_rows")))
    return materialize(aim.alias("a").join(last.alias("e"), same, "left").select("a.*", *(f"e.{c}" for c in last.columns[1:])), "mix-plan")


def taken(table: DataFrame, sources: DataFrame, whole: bool) -> DataFrame:
    """``table`` with source_size, target, copies (whole ones) and part (words of one more)."""
    t, s = table.alias("t"), small(sources).alias("s")
    out = t.join(s, F.col("t.source").eqNullSafe(F.col("s.source")))
    before = (F.col("s.budget") > 0) & ((F.col("__key") < F.col("last_key")) | (F.col("__key") == F.col("last_key")) & (
        F.coalesce(F.col("__id") < F.col("last_id"), F.col("__id").isNull() & F.col("last_id").isNotNull())))
    at = (F.col("__key") == F.col("last_key")) & F.col("__id").eqNullSafe(F.col("last_id"))
    # all rows of the source are taken when the budget is all of its words
    if whole:
        extra = F.when(before | at & (2 * F.col("last_left") > F.col("last_words")), 1).otherwise(0)
        part = F.lit(0).cast("long")
    else:
        extra = F.when(before, 1).otherwise(0)
        part = F.when(at, F.least(F.col("__size"), F.floor(F.col("last_left") / F.col("last_rows")))).otherwise(F.lit(0)).cast("long")
    return out.select("t.*", F.col("s.source_size"), F.col("s.target"), (F.col("s.epochs") + extra).cast("long").alias("copies"),
                      part.alias("part"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        epochs: int = EPOCHS, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and part of every row; ``part`` fills the budget to the word."""
    table = materialize(keyed(docs, doc_id, text, source, weight, seed), "mix-sizes")
    out = taken(table, plan(table, weights, epochs), whole=False)
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target",
                      (F.col("copies") * F.col("__size") + F.col("part")).alias("taken"), "copies", "part")


def resample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
             epochs: int = EPOCHS, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as it is taken, whole (the last one where it comes nearer)."""
    rows = keyed(docs, doc_id, text, source, weight, seed, row=True)
    table = materialize(rows.drop("__row"), "mix-sizes")
    out = taken(rows, plan(table, weights, epochs), whole=True)
    return out.where("copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("__row.*")


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                  len(coalesce(text, '')) - len(translate(coalesce(text, ''), '{NOISE}', '')) AS noise FROM documents),
k AS (SELECT *, -ln((('0x' || md5('0:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496)
                / (1.0::DOUBLE / (1.0::DOUBLE + noise::DOUBLE / greatest(size, 1))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS w
      FROM k GROUP BY source),
c AS (SELECT *, {EPOCHS} * source_size AS cap, ({EPOCHS} * source_size)::DOUBLE / w AS ratio FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM c WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least((SELECT arg_min(level, ratio) FROM v WHERE level <= ratio) * w, cap::DOUBLE) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
b AS (SELECT *, floor(target - epochs * source_size + 0.5) AS budget FROM e),
r AS (SELECT doc_id, size, source_size, target, epochs, budget,
             sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id) AS upto
      FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - upto + size)))::BIGINT AS taken FROM r"""
