"""Array and nested-structure operators.

All are higher-order array functions evaluated in the JVM per row, but for the
texts of A7, whose characters are counted and looked up as code points in
Arrow batches; none moves data between rows except the character dictionary
(A7), whose size is bounded by the alphabet and which is built by a partial
aggregation (each task emits only its distinct characters).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The largest code point.
MAX_POINT = 0x10FFFF


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features", vector: bool = False) -> DataFrame:
    """A1: columns -> one vector (Spark ML) or array<double> column."""
    if vector:
        return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def unpack(df: DataFrame, col: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A2: vector or array column -> named columns (``vector_to_array`` + getItem, no UDF)."""
    dt = df.schema[col].dataType.simpleString()
    arr = vector_to_array(F.col(col)) if dt == "vector" else F.col(col)
    return df.select(*keep, *[arr.getItem(i).alias(n) for i, n in enumerate(names)])


def reshape(arr, n_rows: int) -> Column:
    """A3: flat array -> n_rows x (len/n_rows); errors when not divisible."""
    a = _c(arr)
    k = (F.size(a) / F.lit(n_rows)).cast("int")
    body = F.transform(F.sequence(F.lit(0), F.lit(n_rows - 1)), lambda i: F.slice(a, i * k + 1, k))
    return F.when(F.size(a) % n_rows != 0, F.raise_error(F.lit("array length not divisible"))).otherwise(body)


def block_means(df: DataFrame, nested: str, momentum_index: int = 0) -> list[float]:
    """Mean of each block's momentum element over ``df`` - the training part (one aggregate; n_blocks numbers).

    The number of blocks is the largest of any row, so null and short rows
    don't decide it; a block without values sorts last.
    """
    n = df.agg(F.max(F.size(nested))).first()[0] or 0
    if n <= 0:
        return []
    row = df.agg(*[F.avg(F.get(F.get(F.col(nested), F.lit(i)), F.lit(momentum_index))).alias(f"m{i}") for i in range(n)]).first()
    return [row[f"m{i}"] if row[f"m{i}"] is not None else float("inf") for i in range(n)]


def order_blocks(df: DataFrame, nested: str, means: Sequence[float], ascending: bool = True,
                 out: str | None = None) -> DataFrame:
    """A4: reorder particle blocks by their dataset-mean momentum.

    The order is computed once (on the training part) and applied to every
    frame, so train and test share one block order.
    """
    order = sorted(range(len(means)), key=lambda i: (means[i], i), reverse=not ascending)
    blocks = F.array(*[F.get(F.col(nested), F.lit(i)) for i in order])
    return df.withColumn(out or nested, F.when(F.col(nested).isNotNull(), blocks))


def object_pairs(objs, include_self: bool = False) -> Column:
    """A5: all ordered object pairs (i, j), features of i concatenated with j.

    Pairs are generated inside the row (n objects -> n^2 or n(n-1) pairs,
    n fixed by the schema), never across rows.
    """
    o = _c(objs)
    n = F.size(o)
    idx = F.sequence(F.lit(0), n * n - 1)
    pairs = F.transform(idx, lambda t: F.struct((t / n).cast("int").alias("i"), (t % n).alias("j")))
    if not include_self:
        pairs = F.filter(pairs, lambda p: p["i"] != p["j"])
    return F.transform(pairs, lambda p: F.concat(F.element_at(o, p["i"] + 1), F.element_at(o, p["j"] + 1)))


def pick(arr, idx) -> Column:
    """Element ``idx`` (0-based) of each row's array."""
    return F.element_at(_c(arr), _c(idx) + 1)


def one_hot(label, n_classes: int = 2) -> Column:
    """One-hot array of a class index (used by P9)."""
    y = _c(label)
    return F.array(*[(y == k).cast("double") for k in range(n_classes)])


def class_from_one_hot(y) -> Column:
    """True class index from a one-hot (or score) vector."""
    a = _c(y)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def split_chars(text: Column) -> Column:
    """Whole text -> array of its characters (code points), linear time.

    (Indexing with ``substring(text, i, 1)`` would rescan the UTF-8 bytes for
    every position: quadratic in the text length.)
    """
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def char_dictionary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Character -> index (dense, by code point order) with occurrence counts.

    Tasks count the code points of their whole texts and give one row a
    distinct character and batch, and those are indexed with ``dense_rank`` -
    a table bounded by the alphabet.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[int, int] = {}
            for raw in b.column(0):
                points = _code_points(raw)
                if points.max() < 16 * len(points):
                    k = np.bincount(points)
                    found, k = np.flatnonzero(k), k[k > 0]
                else:
                    found, k = np.unique(points, return_counts=True)
                for point, m in zip(found.tolist(), k.tolist()):
                    n[point] = n.get(point, 0) + m
            yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in n], pa.string()), pa.array(n.values(), pa.int64())], ["ch", "n"])

    t = texts.select(F.col(text_col).alias("_t")).filter(F.col("_t").isNotNull() & (F.length("_t") > 0))
    counts = t.mapInArrow(count, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))
    # UTF-8 byte order (Spark's default string order) is code point order.
    w = Window.orderBy("ch")
    return counts.select("ch", (F.dense_rank().over(w) - 1).cast("int").alias("ix"), "n")


def _code_points(text: pa.StringScalar) -> np.ndarray:
    return np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32)


def _entries(dictionary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Code points and indices of a dictionary, one row a character: bounded by the alphabet."""
    rows = dictionary.select("ch", "ix").filter("ch IS NOT NULL AND ix IS NOT NULL").collect()
    return np.array([ord(r["ch"]) for r in rows], np.int64), np.array([r["ix"] for r in rows], np.int64)


def encode_text(texts: DataFrame, dictionary: DataFrame, text_col: str = "text", out: str = "codes") -> DataFrame:
    """A7 encode: text -> array of indices (null: a character without one), looked up by code point in one table."""
    points, ix = _entries(dictionary)
    table, known = np.zeros(MAX_POINT + 1, np.int32), np.zeros(MAX_POINT + 1, bool)
    table[points], known[points] = ix, True
    # Only as much of it as the alphabet needs goes to the tasks; the last entry stands for all beyond.
    end = int(points.max(initial=-1)) + 1
    table, known = table[:end + 1], known[:end + 1]

    @F.arrow_udf("array<int>")
    def run(v: pa.Array) -> pa.Array:
        parts, ends = [np.zeros(0, np.int64)], [0]
        for raw in v:
            if raw.is_valid:
                parts.append(np.minimum(_code_points(raw), end))
            ends.append(ends[-1] + (len(parts[-1]) if raw.is_valid else 0))
        at = np.concatenate(parts)
        codes = pa.array(table.take(at), mask=~known.take(at))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), codes, mask=v.is_null())

    return texts.withColumn(out, run(F.col(text_col)))


def decode_text(codes: DataFrame, dictionary: DataFrame, codes_col: str = "codes", out: str = "text") -> DataFrame:
    """A7 decode: array of indices -> text; the inverse of ``encode_text``; unknown indices give nothing."""
    points, ix = _entries(dictionary)
    order = np.argsort(ix)
    points, ix = np.append(points[order], 0), np.append(ix[order], np.iinfo(np.int64).max)

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        values, ends = v.flatten(), np.append(0, np.cumsum(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        here = values.is_valid().to_numpy(zero_copy_only=False)
        c = values.fill_null(0).to_numpy(zero_copy_only=False)
        back = []
        for i, valid in enumerate(v.is_valid().to_pylist()):
            part = c[ends[i]:ends[i + 1]][here[ends[i]:ends[i + 1]]]
            at = np.searchsorted(ix, part)
            back.append(points[at[ix[at] == part]].astype("<u4").tobytes().decode("utf-32-le") if valid else None)
        return pa.array(back, pa.string())

    return codes.withColumn(out, run(F.col(codes_col).cast("array<int>")))
