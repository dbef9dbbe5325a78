"""Shared pieces: document columns, row identity, keyed joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null document id inside joins and sorts (sorts below every real id).
NULL_ID = -(2 ** 63)
#: A key holding more than 1/HOT_SHARE of all rows is hot; there can be at most HOT_SHARE such keys.
HOT_SHARE = 1000


def text_of(col: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """Identity of a row for joining results back: (id with null as NULL_ID, 64-bit hash of the raw text).

    Rows with the same id and the same text are interchangeable.
    """
    return (F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID).cast("long")),
            F.xxhash64(docs[text_col].cast("string")))


def row_hash(docs: DataFrame) -> Column:
    """64-bit hash of all columns: tells rows of one identity apart; maps count by their JSON."""
    cols = [docs[c] if "map<" not in t else F.to_json(F.struct(docs[c])) for c, t in docs.dtypes]
    return F.xxhash64(*cols, *[docs[c].isNull() for c in docs.columns])


def restrict(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` named by ``kept(k_id, k_hash, k_n)``: ``k_n`` rows per identity.

    All columns of ``docs`` come back unchanged and nothing else, whatever
    their names.  The whole texts move once, on the identity.  Rows of one
    identity that differ elsewhere are numbered in the order of a hash of all
    columns: the first ``k_n`` come out once each; where ``k_n`` is more than
    there are, copies go round all of them.  Reruns give the same rows.
    """
    from pyspark.sql import Window

    cols = docs.columns
    kid, kh = row_key(docs, id_col, text_col)
    packed = docs.select(kid.alias("k_id"), kh.alias("k_hash"), row_hash(docs).alias("k_row"),
                         F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(cols)]).alias("row"))
    j = packed.join(kept.select("k_id", "k_hash", "k_n"), ["k_id", "k_hash"])
    w = Window.partitionBy("k_id", "k_hash")
    ranked = j.withColumn("k_i", F.row_number().over(w.orderBy("k_row"))).withColumn("k_rows", F.count(F.lit(1)).over(w))
    taken = ranked.filter("k_i <= k_n")
    out = taken.withColumn("k_copy", F.explode(F.expr("sequence(0, cast(k_n - k_i as int), cast(k_rows as int))")))
    return out.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(cols)])


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """``rows`` joined to one row per ``key`` of ``groups``, hot keys apart.

    Keys with more than ``n_rows / HOT_SHARE`` rows are at most HOT_SHARE many
    whatever the data, so that part of ``groups`` is broadcast and their rows
    never move; every other key is small and goes through an ordinary join.
    """
    hot = groups.filter(F.col(size) * HOT_SHARE > F.lit(n_rows))
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot_key"))),
                       F.col(key) == F.col("_hot_key"), "left")
    big = marked.filter(F.col("_hot_key").isNotNull()).drop("_hot_key").join(F.broadcast(hot), key)
    rest = marked.filter(F.col("_hot_key").isNull()).drop("_hot_key") \
        .join(groups.filter(F.col(size) * HOT_SHARE <= F.lit(n_rows)), key)
    return big.unionByName(rest)
