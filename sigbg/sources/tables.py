"""Table scans.

All readers go through ``spark.read.parquet`` so Catalyst prunes columns and
pushes filters into the scan; nothing reads a whole table into one process.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Scan a named table; optional column list is pruned into the scan."""
    ship_package(spark)
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_pruned(spark: SparkSession, sf_dir: str, name: str, keep_substrings: Iterable[str],
                first: str | None = None) -> DataFrame:
    """S2 + P2: scan only the columns whose name contains one of the substrings.

    Order of the table is kept, duplicates removed, and ``first`` (the label)
    re-appended in front, as the reference's branch pruning does.
    """
    df = read_table(spark, sf_dir, name)
    cols = pruned_columns(df.columns, keep_substrings, first)
    return df.select(*cols)


def pruned_columns(columns: Sequence[str], keep_substrings: Iterable[str], first: str | None = None) -> list[str]:
    subs = list(keep_substrings)
    out: list[str] = []
    for c in columns:
        if any(s in c for s in subs) and c not in out and c != first:
            out.append(c)
    return ([first] if first else []) + out


def read_all(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """S2 multi-table form: every named table, sorted by name."""
    return {n: read_table(spark, sf_dir, n) for n in sorted(names or TABLES)}


def read_head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows of an explicit order (files have no row order).

    The limit is the feature here; Spark plans it as TakeOrderedAndProject
    (a per-partition top-n, then a merge of n rows per partition).
    """
    return df.orderBy(*[F.col(c) for c in order]).limit(n)
