"""Distributed running aggregates (two-level prefix sums).

A window ``ORDER BY x`` without ``PARTITION BY`` moves every row into one
task.  ROC curves, exact quantiles, working points, exact-n sampling and
batch numbering all need such running totals over a global order, so they
share this helper:

1. every row gets a *block* id that is a monotone function of the order key
   (hash prefix for md5 orders, ``blocks.value_blocks`` for values);
2. the running total inside each (partition, block) is a window over that
   block only (the one full shuffle, on the block keys);
3. per (partition, block) totals are a partial aggregate of the input (a
   second, column-pruned read whose shuffle carries one row per task and
   block) -- at most ``groups x blocks`` rows, a bounded table AQE
   broadcasts after checking its size;
4. block offsets are a running total over that small table, added back.

Result is exactly the single-window answer, but work is spread over
``blocks`` tasks, and a hot partition key (one class holding a third of all
rows) is split by the block column, not handled by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through

BLOCK = "_blk"


MAX_BROADCAST_GROUPS = 10_000


def nullsafe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the key columns come from the left once.

    The keys are compared as one struct, which is never null itself.
    """
    r = right.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_jk"),
                     *[c for c in right.columns if c not in keys])
    lft = left.withColumn("_jk", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    return lft.join(r, "_jk", how).drop("_jk")


def join_group_stats(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the statistics of its group (``stats``: one row per group; null is a group).

    The statistics are stored and counted: up to MAX_BROADCAST_GROUPS rows go
    to all tasks, so ``df`` - whose group keys may be a handful of hot values -
    is not moved; more of them make an ordinary join.
    """
    s = write_through(stats, "group-stats")
    return nullsafe_join(df, F.broadcast(s) if s.count() <= MAX_BROADCAST_GROUPS else s, by)


def one_group(col: str | Column) -> Column:
    """0 for every row, as a value of ``col`` that the optimizer can't fold: one group that still joins by key."""
    return F.xxhash64(col).bitwiseAND(F.lit(0)).cast("int")


def _order_exprs(order: Sequence, descending: bool) -> list[Column]:
    out = []
    for o in order:
        c = F.col(o) if isinstance(o, str) else o
        out.append(c.desc() if descending else c.asc())
    return out


def running(df: DataFrame, *, order: Sequence, values: dict[str, Column | str],
            block: Column | str, partition_by: Sequence[str] = (),
            descending: bool = False, how: str = "sum", inclusive: bool = True) -> DataFrame:
    """Append one running-aggregate column per entry of ``values``.

    ``order`` must be a total order within each partition for row semantics
    (ties would otherwise be broken arbitrarily).  ``block`` must be
    non-decreasing along ``order`` (non-increasing when ``descending``).
    ``how`` is ``sum`` or ``max``; ``inclusive=False`` excludes the current row.
    """
    if how not in ("sum", "max"):
        raise ValueError(how)
    agg = F.sum if how == "sum" else F.max
    part = list(partition_by)
    blk = F.col(block) if isinstance(block, str) else block
    # Partition and block in one struct: never null itself, so a null partition is one like any other.
    d = df.withColumn(BLOCK, F.struct(*[F.col(p).alias(f"p{i}") for i, p in enumerate(part)], blk.alias("b")))
    vals = {n: (F.col(v) if isinstance(v, str) else v) for n, v in values.items()}
    tmp = {n: f"_v_{i}" for i, n in enumerate(vals)}
    for n, c in vals.items():
        d = d.withColumn(tmp[n], c)

    # 1. running aggregate inside each (partition, block): one shuffle on the keys.
    wl = Window.partitionBy(BLOCK).orderBy(*_order_exprs(order, descending)) \
               .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    for i, n in enumerate(vals):
        d = d.withColumn(f"_l_{i}", agg(tmp[n]).over(wl))
    # 2. block totals: a map-side-combined aggregate of the (pruned) input.
    totals = d.groupBy(BLOCK).agg(*[agg(tmp[n]).alias(f"_t_{i}") for i, n in enumerate(vals)])
    wb = Window.partitionBy(*([f"{BLOCK}.p{i}" for i in range(len(part))] or [F.lit(0)]))
    wb = wb.orderBy(F.col(f"{BLOCK}.b").desc() if descending else F.col(f"{BLOCK}.b").asc()) \
           .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(BLOCK, *[agg(f"_t_{i}").over(wb).alias(f"_o_{i}") for i in range(len(vals))])
    # 3. add each block's offset (a small table; AQE broadcasts it after a size check).
    d = d.join(offsets, BLOCK, "left")
    for i, n in enumerate(vals):
        local = F.col(f"_l_{i}")
        off = F.col(f"_o_{i}")
        if how == "sum":
            d = d.withColumn(n, F.coalesce(off, F.lit(0)) + F.coalesce(local, F.lit(0)))
        else:
            d = d.withColumn(n, F.greatest(off, local))
    drop = [BLOCK] + list(tmp.values()) + [f"_o_{i}" for i in range(len(vals))] + \
        [f"_l_{i}" for i in range(len(vals))]
    return d.drop(*drop)


def row_number(df: DataFrame, *, order: Sequence, block: Column | str,
               partition_by: Sequence[str] = (), name: str = "rn",
               descending: bool = False) -> DataFrame:
    """Exact 1-based row number over a total order, computed per block."""
    return running(df, order=order, values={name: F.lit(1).cast("bigint")}, block=block,
                   partition_by=partition_by, descending=descending)


def fixed_blocks(key, lo: int, hi: int, n_blocks: int) -> Column:
    """Block id from equal-width ranges of an integer key over [lo, hi].

    Keys outside the range are clipped to the first/last block, which keeps
    the block monotone in the key (correctness) and only costs balance.  For
    a rounded probability (keys 0..1e9) a block holds at most
    1e9 / n_blocks distinct keys, whatever the table size.
    """
    k = F.col(key) if isinstance(key, str) else key
    width = (hi - lo + 1) / float(n_blocks)
    b = F.floor((k.cast("double") - F.lit(float(lo))) / F.lit(width)).cast("int")
    return F.least(F.greatest(b, F.lit(0)), F.lit(n_blocks - 1))
