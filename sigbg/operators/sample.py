"""Repeatable shuffling, splitting, balancing and batching.

Every random choice is ``md5(seed:key)`` (see ``functions.hashing``), so a
split does not change when the input is repartitioned or a task is re-run
after an executor loss.  Exact-n selections ("the first k rows of a
shuffled class") use the blocked row number from ``operators.prefix``:
blocks are leading hex digits of the same md5, so they are balanced by
construction and a class holding a third of the table is spread over
thousands of tasks instead of one.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_block, hash_bucket, hash_hex
from ..session import ship_package, write_through
from .prefix import join_group_stats, nullsafe_join, one_group, row_number

HASH = "_h"
BLK = "_hb"
ROWS_PER_BLOCK = 100_000
#: Draws that one row's key holds on average, in oversampling.
SLOTS_PER_KEY = 1_000


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def with_hash(df: DataFrame, seed, key, extra: Sequence[Column | str] = ()) -> DataFrame:
    return df.withColumn(HASH, hash_hex(seed, *extra, *_keys(key)))


def ranked(df: DataFrame, seed, key, partition_by: Sequence[str] = (), name: str = "rn",
           digits: int | None = None, seed_cols: Sequence[str] = ()) -> DataFrame:
    """Exact 1-based rank of each row in md5 order (per partition).

    ``digits`` leading hex digits form the blocks; by default enough of them
    that a block holds about ROWS_PER_BLOCK rows (at least 16^3 blocks), so no
    single window task grows with the table.
    """
    if digits is None:
        digits = max(3, math.ceil(math.log(max(1, df.count()) / ROWS_PER_BLOCK + 1, 16)))
    d = df.withColumn(HASH, hash_hex(seed, *seed_cols, *_keys(key)))
    return row_number(d, order=[HASH, *_keys(key)], block=hash_block(F.col(HASH), digits),
                      partition_by=partition_by, name=name).drop(HASH)


def first_by_hash(df: DataFrame, hashed: Column, k: Callable[[Column], Column], keys: Sequence[str],
                  by: Sequence[str] = (), name: str = "first") -> DataFrame:
    """Marks the first ``k(n)`` of the n rows of every group in hash order, without ranking the table.

    ``hashed`` is a hex string.  Rows are counted per group and block of leading
    hash digits; the running count over blocks finds the block in which the
    last wanted row lies.  Rows of lower blocks are in, of higher ones out, and
    only that one block of each group is ranked: the table is read and
    filtered but never shuffled whole.  A null group is one like any other.
    """
    d = df.withColumn(HASH, hashed)
    part = list(by) or ["_all"]
    if not by:
        d = d.withColumn("_all", one_group(HASH))
    digits = max(3, math.ceil(math.log(max(1, df.count()) / ROWS_PER_BLOCK + 1, 16)))
    d = d.withColumn(BLK, hash_block(F.col(HASH), digits))
    counts = write_through(d.groupBy(*part, BLK).agg(F.count(F.lit(1)).alias("_c")), "hash-blocks")
    group = Window.partitionBy(*part)
    c = counts.withColumn("_before", F.coalesce(F.sum("_c").over(group.orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("_k", k(F.sum("_c").over(group)).cast("long"))
    # Per group: the last block that lies below row k as a whole, the block that holds it, and the rows to take there.
    holds = (F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_c") > F.col("_k"))
    cut = c.groupBy(*part).agg(F.max(F.when(F.col("_before") + F.col("_c") <= F.col("_k"), F.col(BLK))).alias("_below"),
                               F.max(F.when(holds, F.col(BLK))).alias("_cut"),
                               F.max(F.when(holds, F.col("_k") - F.col("_before"))).alias("_need"))
    d = join_group_stats(d, cut, part)
    at_cut = F.col(BLK).eqNullSafe(F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(*part, BLK).orderBy(HASH, *keys))
    inside = d.filter(at_cut).withColumn(name, rank <= F.col("_need"))
    outside = d.filter(~at_cut).withColumn(name, F.coalesce(F.col(BLK) <= F.col("_below"), F.lit(False)))
    return inside.unionByName(outside).drop(HASH, BLK, "_cut", "_need", "_below", "_all")


def shuffle(df: DataFrame, seed, key) -> DataFrame:
    """K9: rows in a repeatable random order (a distributed range sort on md5)."""
    return df.withColumn(HASH, hash_hex(seed, *_keys(key))).orderBy(HASH, *_keys(key)).drop(HASH)


def buffer_shuffle(df: DataFrame, buffer: int, seed: int = 42) -> DataFrame:
    """K9, buffered form: each partition's rows leave through a buffer of ``buffer`` rows, a random one at a time.

    Nothing moves between tasks and a task holds the buffer and one batch.
    Adds part, source_place (of the row in its partition) and place (after the
    shuffle): a row never leaves more than ``buffer`` places early.  The draws
    hang on seed and partition alone, so a task that runs again gives the same
    order if its input does, as a file scan's is.
    """
    ship_package(df.sparkSession)
    cols = df.columns

    def task(batches):
        part = TaskContext.get().partitionId()
        r = random.Random(f"{seed}:{part}")
        held, seen, given = None, 0, 0

        def out(table, order):
            nonlocal given
            got = table.take(pa.array(order, pa.int64()))
            places = pa.array(range(given, given + len(order)), pa.int64())
            given += len(order)
            return got.append_column("part", pa.array([part] * len(order), pa.int32())).append_column("place", places).to_batches()

        for b in batches:
            t = pa.Table.from_batches([b]).append_column("source_place", pa.array(range(seen, seen + b.num_rows), pa.int64()))
            seen += b.num_rows
            at = held.num_rows if held is not None else 0
            t = pa.concat_tables([held, t]).combine_chunks() if at else t
            slots, order = list(range(at)), []
            for i in range(at, t.num_rows):
                if len(slots) < buffer:
                    slots.append(i)
                else:
                    j = r.randrange(buffer)
                    order.append(slots[j])
                    slots[j] = i
            if order:
                yield from out(t, order)
            held = t.take(pa.array(slots, pa.int64()))
        if held is not None and held.num_rows:
            order = list(range(held.num_rows))
            r.shuffle(order)
            yield from out(held, order)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", source_place long, part int, place long"
    return df.select(*cols).mapInArrow(task, schema)


def hash_split(df: DataFrame, fractions: Sequence[float], seed, key, name: str = "split") -> DataFrame:
    """Split by hash bucket (approximate fractions, no shuffle at all)."""
    b = hash_bucket(seed, *_keys(key), modulo=10000)
    edges, acc = [], 0.0
    for f in fractions[:-1]:
        acc += f
        edges.append(int(round(acc * 10000)))
    expr = F.lit(len(fractions) - 1)
    for i in reversed(range(len(edges))):
        expr = F.when(b < edges[i], F.lit(i)).otherwise(expr)
    return df.withColumn(name, expr.cast("int"))


def exact_split(df: DataFrame, test_fraction: float, seed, key, name: str = "is_test") -> DataFrame:
    """Shuffled split; test = the first ceil(f * n) rows of the md5 order."""
    keys = _keys(key)
    r = first_by_hash(df, hash_hex(seed, *keys), lambda n: F.ceil(n * F.lit(float(test_fraction))), keys, name=name)
    return r.withColumn(name, F.col(name).cast("int"))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))


def undersample(df: DataFrame, label: str, seed, key) -> DataFrame:
    """Exactly min-class-size rows of every class (null is a class), chosen in md5 order."""
    keys = _keys(key)
    m = class_sizes(df, label).agg(F.min("_n")).first()[0] or 0
    return first_by_hash(df, hash_hex(seed, *keys), lambda n: F.lit(m), keys, [label]).filter("first").drop("first")


def oversample(df: DataFrame, label: str, seed, key) -> DataFrame:
    """Max-class-size (M) draws with replacement from every class.

    Draw slots 0..M-1 of every class are generated by the rows of the
    largest class (exactly M rows, spread over the tasks like the data; the
    class list is a bounded array), so a tiny class never makes one task
    emit M slots.  Each slot picks a row index by md5 and is joined back on
    (class, rank, share): where a class is so small that a row is drawn more
    than SLOTS_PER_KEY times on average, its slots are dealt to shares by their
    number and its rows are copied to each, M / SLOTS_PER_KEY copies a class at
    most, so that no key holds many more slots than that.
    """
    sizes = class_sizes(df, label)
    classes = sizes.agg(F.collect_list(F.struct(F.col(label).alias("c"), F.col("_n").alias("n"))).alias("a"),
                        F.max_by(F.struct(F.col(label).alias("c")), F.struct(F.col("_n"), F.col(label))).alias("big"))
    info = classes.select(F.struct("a", "big").alias("s")).scalar()
    r = ranked(df, seed, key, partition_by=[label])
    big = r.withColumn("_info", info).filter(F.col(label).eqNullSafe(F.col("_info.big.c")))
    slots = big.select((F.col("rn") - 1).alias("draw"), F.explode("_info.a").alias("_cls")) \
               .select(F.col("_cls.c").alias(label), F.col("_cls.n").alias("_n"), "draw")
    h = hash_hex(seed, F.coalesce(F.col(label).cast("string"), F.lit("null")), F.col("draw"))
    pick = (F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint") % F.col("_n")) + 1
    shares = lambda n, most: F.greatest(F.ceil(most / n / SLOTS_PER_KEY), F.lit(1)).cast("int")
    most = F.array_max(F.transform(F.col("_info.a"), lambda x: x["n"]))
    slots = slots.withColumn("_info", info).select(label, "draw", pick.alias("rn"), F.pmod("draw", shares(F.col("_n"), most)).cast("int").alias("_share"))
    own = F.filter(F.col("_info.a"), lambda x: x["c"].eqNullSafe(F.col(label)))[0]["n"]
    r = r.withColumn("_info", info).withColumn("_share", F.explode(F.sequence(F.lit(0), shares(own, most) - 1))).drop("_info")
    return nullsafe_join(slots, r, [label, "rn", "_share"]).drop("rn", "_share")


def drop_fraction(df: DataFrame, label: str, cls: int, fraction: float, seed, key) -> DataFrame:
    """Remove round(f * n) rows of one class (md5 order), keep the rest."""
    keys = _keys(key)
    hit = F.col(label).eqNullSafe(F.lit(cls))
    r = first_by_hash(df.filter(hit), hash_hex(seed, *keys), lambda n: F.round(n * F.lit(float(fraction))), keys)
    return r.filter("NOT first").drop("first").unionByName(df.filter(~hit))


def positional_slice(df: DataFrame, seed, key, start: int, stop: int) -> DataFrame:
    """Rows [start, stop) of the shuffled order (iloc semantics)."""
    keys = _keys(key)
    r = first_by_hash(df, hash_hex(seed, *keys), lambda n: F.lit(stop), keys, name="_head").filter("_head").drop("_head")
    return first_by_hash(r, hash_hex(seed, *keys), lambda n: F.lit(start), keys, name="_skip").filter("NOT _skip").drop("_skip")


def stratified_splits(df: DataFrame, label: str, key, n_splits: int = 4, test_size: float = 0.25,
                      seed: int = 28) -> DataFrame:
    """N repeated stratified shuffle splits; per class the first round(f n_c) rows are test."""
    keys = _keys(key)
    rep = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    r = first_by_hash(rep, hash_hex(seed, "repeat", *keys), lambda n: F.round(n * F.lit(float(test_size))), keys,
                      ["repeat", label], name="is_test")
    return r.withColumn("is_test", F.col("is_test").cast("int"))


def stratified_folds(df: DataFrame, label: str, key, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """fold = (rank within class - 1) mod k; usable as ``CrossValidator(foldCol=...)``."""
    r = ranked(df, seed, key, partition_by=[label])
    return r.withColumn(name, ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def batches(df: DataFrame, key, batch_size: int, epochs: int = 1, seed: int = 42) -> DataFrame:
    """(epoch, step) for every row; each epoch is a fresh md5 shuffle.

    Epochs are generated per row (``explode(sequence)``), not by a cross join;
    the tail batch of an epoch is kept (smaller than ``batch_size``).
    """
    rep = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    r = ranked(rep, seed, key, partition_by=["epoch"], seed_cols=["epoch"])
    return r.withColumn("step", F.floor((F.col("rn") - 1) / F.lit(batch_size)).cast("bigint")).drop("rn")


def complement(df: DataFrame, subset: DataFrame, key) -> DataFrame:
    """Rows of ``df`` whose key is not in ``subset`` (anti join)."""
    return df.join(subset.select(*_keys(key)), _keys(key), "left_anti")


def tag_union(frames: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """Union by column name with a source tag."""
    out = None
    for tag, f in frames.items():
        t = f.withColumn(name, F.lit(tag))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def balanced_sample(df: DataFrame, label: str, seed, key, under: bool = True) -> DataFrame:
    """A sample of equal size from every class (the smallest's rows, or draws to the largest's), shuffled."""
    s = undersample(df, label, seed, key) if under else oversample(df, label, seed, key).drop("draw")
    return shuffle(s, seed, key)
