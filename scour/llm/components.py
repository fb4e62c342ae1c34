"""Connected components of a link table by alternating large and small stars.

Each round rewrites the links so that every node points at the smallest node it
can see; it ends when the links are stars.  Rounds are written to the shared
folder, so the lineage never grows, and nothing is collected: the driver sees
only a count and a checksum per round.  A node with very many links is a skewed
join key that AQE splits (both sides of each join are read from tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star step over links (a, b); ``small`` looks at smaller neighbours only."""
    if small:
        sees = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        sees = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = materialize(sees.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
    out = sees.join(low, "u")
    if small:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return materialize(out.where(F.col("a") != F.col("b")).distinct(), "cc-links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): root is the smallest node it can reach.

    Self links, repeated links and links both ways are harmless; links with a
    null end are left out; no links give no rows.
    """
    links = materialize(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "cc-links")
    seen = None
    while True:
        links = _star(_star(links, small=False), small=True)
        mark = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
