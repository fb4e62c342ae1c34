"""From raw documents to packed training windows, a stage at a time.

Quality rules drop junk, line dedup cuts what earlier documents have, SimHash
keeps one document of each near-duplicate group, mixing resamples the sources to
their target weights, packing lays the result out in windows.  Every stage reads
the table the one before has written, so a lost executor never costs more than
the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.llm import linededup, mixing, packing, rules, simhash
from scour.llm.common import table
from scour.llm.queries import tokenizer
from scour.session import delete_path, scratch_path, scratch_scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of earlier ones; a document that loses all its words goes."""
    out = linededup.dedup(docs)
    left = out.where((F.col("removed_words") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))

    def column(name: str, kind: str) -> Column:
        if name == "text":
            return F.col("text")
        own = F.col(f"row.`{name}`")
        if name == "n_chars":
            return F.when(F.col("removed_words") > 0, F.char_length("text")).otherwise(own).cast(kind).alias(name)
        return own

    return left.select(*(column(c, t) for c, t in docs.dtypes))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash component."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mixture takes it."""
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture in windows of 2048 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_duplicates),
          ("mixing to target weights", mix_sources), ("packing", pack)]

#: SimHash components and BPE ids have no SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        with scratch_scope(spark):  # what the stage wrote on its way goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
