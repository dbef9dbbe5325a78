"""Global token streams from range-sorted runs.

Each task holds a run of the global order (``map_runs``); ``with_offsets`` adds
to every row the number of tokens of all runs before its own.  Only one row per
run takes part in the running sum over runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 256


def batches_of(texts: list, n: int = BATCH, size: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """(first index, texts) a few MB at a time."""
    first, part, total = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t)
        total += len(t)
        if len(part) >= n or total >= size:
            yield first, part
            first, part, total = i + 1, [], 0
    if part:
        yield first, part


def map_runs(ordered: DataFrame, task: Callable, schema: str) -> DataFrame:
    """``task(run, batches)`` over each sorted partition; run is its number in the global order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(TaskContext.get().partitionId(), batches)

    return ordered.mapInArrow(run, schema)


def with_offsets(rows: DataFrame, run: str, n: str, name: str = "run_start") -> DataFrame:
    """Adds the sum of ``n`` over all runs before the row's own.

    One row per run - as many as the sort had partitions, a bound that doesn't
    come from the data - is summed in order and broadcast.
    """
    totals = rows.groupBy(run).agg(F.sum(n).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(run).rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(run, F.coalesce(before, F.lit(0)).cast("long").alias(name))
    return rows.join(F.broadcast(offsets), run)
