"""Corpus preparation: STAGES applied to ``documents``, each written as Parquet and reread.

Quality classifier, exact dedup, near dedup, mixing, packing.  Every stage but
the last returns the columns of its input, whatever extra ones it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigbg.llm import cuckoo_dedup, curve_packing, near_dedup, quality_lm, systematic_mix
from sigbg.llm.common import restrict
from sigbg.session import ship_package, write_through
from sigbg.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model accepts stay (operator 10); repeated rows fare alike."""
    ship_package(spark)
    labels = read_table(spark, sf_dir, "labels")
    return quality_lm.keep(docs, labels)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays (operator 4)."""
    ship_package(spark)
    kept = cuckoo_dedup.dedup(docs).filter("kept")
    return restrict(docs, kept.select("k_id", "k_hash", F.lit(1).alias("k_n")))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 9; five words, 0.8)."""
    ship_package(spark)
    return restrict(docs, near_dedup.representatives(near_dedup.near_groups(docs, k=5, percent=80, symbols=40)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice (operator 8)."""
    ship_package(spark)
    taken = systematic_mix.mix(docs).groupBy("k_id", "k_hash").agg(F.sum("copies").alias("k_n")).filter("k_n > 0")
    return restrict(docs, taken)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens (operator 1)."""
    ship_package(spark)
    return curve_packing.pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dups), ("mix", mix), ("pack", pack)]

#: Model, signatures and tokenizer can't be written in SQL; tests/llm compares with plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    df = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        df = write_through(stage(spark, df, sf_dir), f"pipeline-{name}")
    return df
