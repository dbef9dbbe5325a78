"""Custom functions over groups of raw rows, by mergeable states.

A function sees its group's rows batch by batch where they lie, and keeps a
state; states of one group are merged, first those of up to SHARES shares of
the tasks, then the shares.  No task ever holds a group's rows, so a group may
be a third of the table: one state a task moves.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

SHARES = 64
#: States that a task holds before it hands them on.
MAX_STATES = 10_000


@dataclass(frozen=True)
class GroupFunction:
    """``update(state, columns)`` over NumPy columns of a batch's rows of one group, ``merge(a, b)``, ``finish(state)`` -> row."""

    init: Callable[[], Any]
    update: Callable[[Any, dict[str, np.ndarray]], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], dict]


def apply_mergeable(df: DataFrame, by: str, columns: Sequence[str], fn: GroupFunction, schema: str) -> DataFrame:
    """One row per group of ``by`` (null is a group): ``by`` and the fields of ``schema`` as ``fn.finish`` gives them.

    ``merge`` must not depend on the order of its states beyond rounding.
    """
    ship_package(df.sparkSession)
    kind = dict(df.dtypes)[by]

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, held, types = TaskContext.get().partitionId() % SHARES, {}, None

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), types), pa.array([share] * len(held), pa.int32()),
                                              pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], ["key", "share", "state"])
            held.clear()
            return out

        for b in batches:
            types = b.schema.field(0).type
            codes = pc.dictionary_encode(b.column(0), null_encoding="encode")
            index = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(index, kind="stable")
            cols = {c: b.column(i + 1).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
            keys = codes.dictionary.to_pylist()
            for rows in np.split(order, np.flatnonzero(np.diff(index[order])) + 1) if len(order) else ():
                key = keys[index[rows[0]]]
                held[key] = fn.update(held[key] if key in held else fn.init(), {c: x[rows] for c, x in cols.items()})
            if len(held) > MAX_STATES:
                yield give()
        if held:
            yield give()

    def merged(table: pa.Table) -> Any:
        total = None
        for raw in table.column("state"):
            s = pickle.loads(raw.as_py())
            total = s if total is None else fn.merge(total, s)
        return total

    def share(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"key": table.column("key")[:1], "state": pa.array([pickle.dumps(merged(table))], pa.binary())})

    fields = df.sparkSession.createDataFrame([], schema).schema.names

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        row = fn.finish(merged(table))
        return pa.table({"key": table.column("key")[:1]} | {f: pa.array([row[f]]) for f in fields})

    rows = df.select(F.col(by).alias("key"), *columns)
    first = rows.mapInArrow(states, f"key {kind}, share int, state binary")
    second = first.groupBy("key", "share").applyInArrow(share, f"key {kind}, state binary")
    return second.groupBy("key").applyInArrow(finish, f"key {kind}, {schema}").withColumnRenamed("key", by)


def moments_and_largest(value: str, n: int = 3) -> GroupFunction:
    """Rows, mean, population spread and the ``n`` largest values of a column; missing values are left out."""
    def update(s, cols):
        x = cols[value].astype(np.float64)
        x = x[~np.isnan(x)]
        return merge(s, (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum()), sorted(x, reverse=True)[:n])) if len(x) else s

    def merge(a, b):
        k = a[0] + b[0]
        if not k:
            return a
        d = b[1] - a[1]
        return k, a[1] + d * b[0] / k, a[2] + b[2] + d * d * a[0] * b[0] / k, sorted([*a[3], *b[3]], reverse=True)[:n]

    def finish(s):
        return {"n": s[0], "mean": s[1] if s[0] else None, "spread": (s[2] / s[0]) ** 0.5 if s[0] else None, "largest": [float(v) for v in s[3]]}

    return GroupFunction(lambda: (0, 0.0, 0.0, []), update, merge, finish)
