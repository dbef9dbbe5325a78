"""Order-preserving block index: values cut into blocks of bounded size, edges kept as a table.

A value becomes a 64-bit key that sorts like it (``order_key``).  Rows are
counted by the leading DIGIT bits of the key; prefixes that hold more than the
block size are counted again by the next DIGIT bits, and so on, so that values
within a hair of each other, saturated scores and wide ranges all end in blocks
of bounded size after at most 64 / DIGIT passes.  Neighbouring prefixes of one
parent are joined into a block until it is full.

The index is a set of stored tables (prefix -> block), one a pass: no edge is
collected to the driver or written into a plan.  A pass adds at most
2 ** DIGIT rows for each prefix that is too large.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .prefix import one_group

#: Bits of the key that a pass looks at.
DIGIT = 12
#: Rows of a block.
BLOCK_ROWS = 100_000
#: Bytes of a text that its key holds.
TEXT_BYTES = 7
NULL_KEY = -(2 ** 63)

# Fixed values of the 64-bit floating point format.
_MANTISSA, _BIAS, _LEAST = 52, 1023, -1022


def float_key(value: Column) -> Column:
    """The bits of a double as a long that sorts like it; -0.0 equals 0.0, NaN is above all, null below.

    Exponent and mantissa come out by arithmetic that is exact: the logarithm
    only guesses the exponent, two comparisons put it right.
    """
    x = value.cast("double")
    a = F.abs(x)
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(F.greatest(a, F.lit(2.0 ** _LEAST)))).cast("int")
    up = F.when(guess < F.lit(_BIAS), a >= two(guess + 1)).otherwise(F.lit(False))
    exp = guess + F.when(up, 1).when(a < two(guess), -1).otherwise(0)
    exp = F.greatest(exp, F.lit(_LEAST))
    mantissa = ((a / two(exp) - F.lit(1.0)) * F.lit(2.0 ** _MANTISSA)).cast("long")
    normal = F.shiftleft((exp + _BIAS).cast("long"), _MANTISSA) + mantissa
    small = (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")                # below the normal range: multiples of 2 ** -1074
    top = F.lit(0x7FF << _MANTISSA).cast("long")
    # Each branch guards itself: a CASE may be evaluated in parts.
    finite = F.when(a < F.lit(2.0 ** _LEAST), small).when(a < F.lit(float("inf")), normal).otherwise(top)
    return F.when(x.isNull(), F.lit(NULL_KEY).cast("long")).when(F.isnan(x), top + 1).when(x < 0, -finite).otherwise(finite)


def order_key(df: DataFrame, col: str) -> Column:
    """A long that never falls as ``col`` rises: exact for numbers up to 64 bits, dates and times.

    Decimals go by their double, texts by their first TEXT_BYTES bytes, so
    that values may share a key but never swap places.  Null is lowest.
    """
    kind, c = dict(df.dtypes)[col], F.col(col)
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        key = c.cast("int").cast("long") if kind == "boolean" else c.cast("long")
    elif kind in ("double", "float") or kind.startswith("decimal"):
        return float_key(c)
    elif kind == "date":
        key = F.unix_date(c).cast("long")
    elif kind.startswith("timestamp"):
        key = F.unix_micros(c.cast("timestamp"))
    elif kind in ("string", "binary"):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, TEXT_BYTES)), 2 * TEXT_BYTES, "0")
        key = F.conv(head, 16, 10).cast("long")
    else:
        raise TypeError(f"{col}: no order for {kind}")
    return F.coalesce(key, F.lit(NULL_KEY).cast("long"))


@dataclass(frozen=True)
class BlockIndex:
    """Tables (prefix, block, rows), one a pass; an empty list is one block."""

    passes: list[DataFrame]

    def shift(self, i: int) -> int:
        return max(0, 64 - DIGIT * (i + 1))

    def assign(self, df: DataFrame, key: Column, out: str) -> DataFrame:
        """Adds the block of ``key``: the lowest key of the block's range, so blocks sort like keys."""
        d, found = df.withColumn("_bk", key), []
        for i, t in enumerate(self.passes):
            # A key's prefix is in one table only; small tables are broadcast by their size.
            d = d.withColumn("_bp", F.shiftright("_bk", self.shift(i))) \
                .join(t.select(F.col("prefix").alias("_bp"), F.col("block").alias(f"_b{i}")), "_bp", "left")
            found.append(f"_b{i}")
        return d.withColumn(out, F.coalesce(*found)).drop("_bk", "_bp", *found)

    def edges(self) -> DataFrame:
        """(block, rows): every block's lowest key and its rows as counted."""
        t = self.passes[0]
        for p in self.passes[1:]:
            t = t.unionByName(p)
        return t.groupBy("block").agg(F.sum("rows").alias("rows"))


def block_index(df: DataFrame, key: Column, rows_per_block: int = BLOCK_ROWS) -> BlockIndex:
    """Exact radix counting of ``key`` until no prefix holds more than ``rows_per_block`` rows (or one key alone does)."""
    rows, passes, i = df.select(key.alias("key")), [], 0
    index = BlockIndex(passes)
    while True:
        shift = index.shift(i)
        counts = write_through(rows.groupBy(F.shiftright("key", shift).alias("prefix")).agg(F.count(F.lit(1)).alias("n")), f"blocks-{i}")
        large = F.col("n") > (rows_per_block if shift else 2 ** 63 - 1)
        # Of one parent at most 2 ** DIGIT prefixes: joined until full; a large one between two keeps them apart.
        w = Window.partitionBy("parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        part = counts.withColumn("parent", F.shiftright("prefix", index.shift(i - 1) - shift)) \
            .withColumn("group", F.floor(F.coalesce(F.sum("n").over(w), F.lit(0)) / rows_per_block))
        leaves = part.filter(~large).withColumn("block", F.shiftleft(F.min("prefix").over(Window.partitionBy("parent", "group")), shift))
        passes.append(write_through(leaves.select("prefix", "block", F.col("n").alias("rows")), f"blocks-{i}-index"))
        heavy = counts.filter(large).select(F.col("prefix").alias("_hp"))
        if not shift or heavy.isEmpty():
            return index
        rows = rows.join(heavy, F.shiftright("key", shift) == F.col("_hp"), "left_semi")
        i += 1


def value_blocks(df: DataFrame, col: str, rows_per_block: int | None = None, out: str = "_vblk") -> DataFrame:
    """Adds a block id that never falls as ``col`` rises, blocks of about ``rows_per_block`` rows (BLOCK_ROWS).

    ``df`` is read once a pass and should be a stored table.  A table that fits
    one block is one block.
    """
    n = rows_per_block or BLOCK_ROWS
    if df.count() <= n:
        return df.withColumn(out, one_group(col))
    key = order_key(df, col)
    return block_index(df, key, n).assign(df, key, out)
