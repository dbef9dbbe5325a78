"""External merge of capture runs by a loser tree (operator 13).

Runs come sorted from the archives they index.  Captures are dealt to ranges
of (URL key, date, page id, run, place), so that a URL with very many captures
is split by its dates and ids; a range holds about RANGE_ROWS captures.  In
each range the pieces of all runs are merged by a loser tree: a leaf for each
run, inner nodes that remember the loser of a match, so that the next capture
costs one match on each level.  Ranges in order are the globally ordered index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Captures of a range, on average.
RANGE_ROWS = 100_000


class LoserTree:
    """Merges sorted runs given as [first, end) places of a list of keys."""

    def __init__(self, keys: list, runs: list[tuple[int, int]]):
        self.keys, self.at, self.end = keys, [a for a, _ in runs], [b for _, b in runs]
        self.k = len(runs)
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _before(self, x: int, y: int) -> bool:
        """Whether run x's next key comes before run y's; a run that has ended comes last."""
        if self.at[x] >= self.end[x]:
            return False
        if self.at[y] >= self.end[y]:
            return True
        a, b = self.keys[self.at[x]], self.keys[self.at[y]]
        return a < b or (a == b and x < y)

    def _play(self, leaf: int) -> None:
        """Matches from a leaf up; an empty place on the way keeps the run until its opponent comes."""
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def merged(self) -> Iterator[int]:
        """Places of all keys in the order of the merge."""
        while self.k and self.at[top := self.losers[0]] < self.end[top]:
            yield self.at[top]
            self.at[top] += 1
            self._play(top)


def merge_order(keys: list, run: list) -> list[int]:
    """Places of ``keys`` merged from its runs: stretches of equal ``run``, each sorted."""
    cuts = [i for i in range(len(run)) if i == 0 or run[i] != run[i - 1]] + [len(run)]
    return list(LoserTree(keys, list(zip(cuts, cuts[1:]))).merged())


def merge_runs(runs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """``runs(run, pos, url_key, date, page_id, ...)`` as one index in the order of its key.

    Adds range (of the global order) and place (in it).  Null page ids come
    last among captures of one URL and date.  Every run must be sorted by
    (url_key, date, page_id) along pos.
    """
    cols = runs.columns
    n = max(1, -(-runs.count() // rows))
    last = F.col("page_id").isNull()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        value = lambda c: table.column(c).to_pylist()
        keys = [(u.encode("utf-8", "surrogatepass"), d, p is None, p or 0) for u, d, p in zip(value("url_key"), value("date"), value("page_id"))]
        order = merge_order(keys, value("run"))
        part = np.full(len(order), TaskContext.get().partitionId(), dtype=np.int32)
        out = table.take(pa.array(order, pa.int64())).append_column("range", pa.array(part)) \
            .append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))
        yield from out.to_batches(max_chunksize=10_000)

    types = dict(runs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in cols) + ", range int, place long"
    return runs.repartitionByRange(n, "url_key", "date", last, "page_id", "run", "pos") \
        .sortWithinPartitions("run", "pos").mapInArrow(task, schema)
