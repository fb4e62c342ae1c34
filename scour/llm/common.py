"""Small helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: A word: a maximal run of anything but space and the ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest table (bytes) that is broadcast; anything larger is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: A key is heavy from one row in this many on, so a table has at most this many heavy keys.
HEAVY = 1024
#: Keys with so few rows are never heavy.
FEW = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with a table all executors share, so a lost executor costs
    a re-read and never a recomputation of what came before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> int:
    """Bytes of a written table's rows: eight and a bit for each column, and the length of each text."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    flat = 16 * (len(df.columns) + 1)
    size = sum(texts, F.lit(flat)).cast("long")
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def small(df: DataFrame) -> DataFrame:
    """Hint a broadcast for a written table of flat columns whose measured size allows it, else leave a plain join."""
    return F.broadcast(df) if measured(df) <= BROADCAST_BYTES else df


def join_heavy(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with a written ``table`` of one row a key, however many rows a key has.

    ``weight`` is a column of ``table``: the rows of its key, at least.  Keys that hold more than one row in ``HEAVY`` are at
    most ``HEAVY``, so their table rows are broadcast and their rows are not shuffled at all; the others are joined
    by a shuffle.  Without heavy keys that is the whole join.  ``total``: how many ``rows`` there are, where that is more
    than the weights' sum (rows without a match).  Null keys match nothing.
    """
    total = max(total or 0, table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0])
    bar = max(total // HEAVY, FEW)
    heavy, light = table.where(F.col(weight) > bar), table.where(F.col(weight) <= bar)
    if not heavy.limit(1).count():
        return rows.join(table.hint("merge"), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rest.join(light.hint("merge"), key).unionByName(rows.join(F.broadcast(heavy), key))


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many "_" before it as it takes to clash with none of ``taken`` (case aside)."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
