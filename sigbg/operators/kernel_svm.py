"""Kernel support-vector machines through random Fourier features.

The Gaussian kernel exp(-gamma |x - y|^2) is the mean of cos(w x + b) cos(w y + b)
over normal w: ``FourierMap`` draws D of them, each number a function of
md5(seed:feature:column), so a linear machine on the mapped rows is a kernel
machine whose kernel error falls as 1 / sqrt(D).

Machines with the squared hinge loss 1/2 |w|^2 + C sum max(0, 1 - y f(x))^2 are
solved by Newton steps: a pass adds up, for every machine, the D x D matrix and
the gradient of the rows inside the margin; a task's sums (half of the symmetric
matrix) are added by machine and solved in the tasks, and only the D + 1 weights
come to the driver.  All
machines of a grid - widths, penalties, splits - share the passes, and a width's
features are computed once a block for all its machines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_through
from .boosting import matrix
from .curves import auc as exact_auc

# The grid of the search.
GRID_C = tuple(10.0 ** k for k in range(-2, 11))
GRID_GAMMA = tuple(10.0 ** k for k in range(-9, 4))
FEATURES = 128
#: Newton steps at most, and the change of the weights that ends them.
STEPS = 25
CLOSE = 1e-6
BLOCK_ROWS = 8192


def _uniform(seed: int | str, *keys) -> float:
    h = hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()
    return (int(h[:13], 16) + 0.5) / 16 ** 13


@dataclass(frozen=True)
class FourierMap:
    """D random features of vectors of ``d`` columns; unit-width draws, scaled by the kernel's width on use."""

    w: np.ndarray
    b: np.ndarray

    @classmethod
    def draw(cls, d: int, features: int = FEATURES, seed: int = 28) -> FourierMap:
        # Two uniform numbers make a normal one.
        w = np.array([[np.sqrt(-2 * np.log(_uniform(seed, j, k, "r"))) * np.cos(2 * np.pi * _uniform(seed, j, k, "a"))
                       for k in range(d)] for j in range(features)])
        b = np.array([2 * np.pi * _uniform(seed, j, "b") for j in range(features)])
        return cls(w.reshape(features, d), b)

    def __call__(self, x: np.ndarray, gamma: float) -> np.ndarray:
        """Features of the rows of ``x``; a constant column for the offset comes last."""
        z = np.sqrt(2 / len(self.b)) * np.cos(np.sqrt(2 * gamma) * (x @ self.w.T) + self.b)
        return np.hstack([z, np.ones((len(x), 1))])


@dataclass
class Machine:
    """One machine of a grid: width, penalty, the split it leaves out, and its weights."""

    gamma: float
    c: float
    split: int
    weights: np.ndarray
    done: bool = False


class Rows:
    """Vectors, labels and split membership of a table as stored blocks (``in_test``: array of 0/1, one a split)."""

    def __init__(self, df: DataFrame, features: str, label: str, in_test: str | None = None):
        self.spark = df.sparkSession
        rows = write_through(df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"),
                                       (F.col(in_test).cast("array<int>") if in_test else F.array().cast("array<int>")).alias("t"))
                             .filter("x IS NOT NULL AND y IS NOT NULL"), "svm-rows")
        self.d = rows.agg(F.max(F.size("x"))).first()[0] or 0
        self.table = rows

    def passes(self, fn, schema: str, end=None) -> DataFrame:
        """``fn(x, y, t, kept)`` over blocks of rows: missing components are 0; ``end(kept)`` gives what a task has kept."""
        d = self.d

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict = {}
            for batch in batches:
                for first in range(0, batch.num_rows, BLOCK_ROWS):
                    b = batch.slice(first, BLOCK_ROWS)
                    t = np.array(b.column(2).to_pylist(), dtype=np.int8).reshape(b.num_rows, -1)
                    yield from fn(np.nan_to_num(matrix(b.column(0), d)), b.column(1).to_numpy(zero_copy_only=False), t, kept)
            if end:
                yield from end(kept)

        return self.table.mapInArrow(task, schema)


def _parts(fourier: FourierMap, machines: Sequence[Machine]):
    """A pass's sums: for each open machine the matrix and the gradient of the rows inside its margin, once a task."""
    widths = sorted({m.gamma for m in machines if not m.done})

    def run(x: np.ndarray, y: np.ndarray, t: np.ndarray, kept: dict):
        sign = 2.0 * y - 1.0
        for g in widths:
            z = fourier(x, g)
            for i, m in enumerate(machines):
                if m.done or m.gamma != g:
                    continue
                use = t[:, m.split] == 0 if t.shape[1] else np.ones(len(y), bool)
                gap = 1.0 - sign * (z @ m.weights)
                near = use & (gap > 0)
                zn = z[near]
                a, b = zn.T @ zn, zn.T @ sign[near]
                if i in kept:
                    kept[i][0] += a
                    kept[i][1] += b
                else:
                    kept[i] = [a, b]
        yield from ()

    def end(kept: dict):
        for i, (a, b) in kept.items():
            sums = np.concatenate([a[np.triu_indices(len(a))], b])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["machine", "sums"])

    return run, end


def fit(rows: Rows, fourier: FourierMap, machines: list[Machine], steps: int = STEPS) -> None:
    """Newton steps until the weights of every machine stand still."""
    n = len(fourier.b) + 1
    half = n * (n + 1) // 2

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(half + n)
        for raw in table.column("sums"):
            total += np.frombuffer(raw.as_py(), np.float64)
        m, a = machines[key[0].as_py()], np.zeros((n, n))
        a[np.triu_indices(n)] = total[:half]
        a = a + np.triu(a, 1).T
        penalty = np.eye(n)
        penalty[-1, -1] = 1e-8                                # the offset is not held down
        w = np.linalg.lstsq(penalty + 2 * m.c * a, 2 * m.c * total[half:], rcond=None)[0]
        return pa.table({"machine": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})

    for step in range(steps):
        if all(m.done for m in machines):
            return
        run, end = _parts(fourier, machines)
        sums = rows.passes(run, "machine int, sums binary", end)
        for r in sums.groupBy("machine").applyInArrow(solve, "machine int, w binary").collect():
            m, w = machines[r["machine"]], np.frombuffer(bytes(r["w"]), np.float64)
            # Half steps late in the run end cycles between two sets of rows inside the margin.
            new = w if step < 8 else (m.weights + w) / 2
            m.done = bool(np.abs(new - m.weights).max() <= CLOSE * max(1.0, np.abs(w).max()))
            m.weights = new


def decisions(rows: Rows, fourier: FourierMap, machines: Sequence[Machine], held: bool = True) -> DataFrame:
    """(machine, labels, score): decision values of the rows that each machine left out (all rows without ``held``)."""
    def run(x: np.ndarray, y: np.ndarray, t: np.ndarray, _: dict):
        for g in sorted({m.gamma for m in machines}):
            z = fourier(x, g)
            for i, m in enumerate(machines):
                if m.gamma == g:
                    use = t[:, m.split] == 1 if held and t.shape[1] else np.ones(len(y), bool)
                    if use.any():
                        k = int(use.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, i, np.int32)), pa.array(y[use].astype(np.int32)), pa.array(z[use] @ m.weights)],
                                                         ["machine", "labels", "score"])

    return rows.passes(run, "machine int, labels int, score double")


def grid_search(spark: SparkSession, df: DataFrame, key: str, features: str = "features", label: str = "labels", c_range: Sequence[float] = GRID_C,
                gamma_range: Sequence[float] = GRID_GAMMA, n_splits: int = 4, test_size: float = 0.25, seed: int = 28,
                n_features: int = FEATURES) -> DataFrame:
    """(C, gamma, n_splits, mean_auc) of every pair of the grid over repeated stratified shuffle splits."""
    from .sample import stratified_splits
    s = stratified_splits(df.select(key, features, label), label, key, n_splits, test_size, seed)
    flags = s.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("repeat", "is_test"))), lambda r: r["is_test"].cast("int")).alias("t"))
    rows = Rows(df.select(key, features, label).join(flags, key), features, label, "t")
    fourier = FourierMap.draw(rows.d, n_features, seed)
    machines = [Machine(g, c, k, np.zeros(n_features + 1)) for g in gamma_range for c in c_range for k in range(n_splits)]
    fit(rows, fourier, machines)
    got = {r["machine"]: r["auc"] for r in exact_auc(decisions(rows, fourier, machines), by=["machine"]).select("machine", "auc").collect()}
    out = []
    for i in range(0, len(machines), n_splits):
        a = [got[i + k] for k in range(n_splits) if got.get(i + k) is not None]
        out.append((machines[i].c, machines[i].gamma, n_splits, float(np.mean(a)) if a else None))
    return spark.createDataFrame(out, "C double, gamma double, n_splits int, mean_auc double")
