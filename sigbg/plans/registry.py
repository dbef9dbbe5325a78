"""Registry of named queries: Spark builder + optional DuckDB oracle SQL.

Every entry reads the driver tables (or views Spark derives from them) in
full.  Entries without SQL are model / random / stream jobs checked by
invariants in the tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    headline: bool = False


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, headline)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # Importing the plan modules fills the registry.
    from . import (arrays, classify, histograms, hist2d, io, models, sampling, scaling,  # noqa: F401
                   selection, streams, working)
    return REGISTRY
