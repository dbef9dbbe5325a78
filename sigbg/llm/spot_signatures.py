"""SpotSigs fingerprints (operator 7); DataFrame functions only.

A spot is an anchor - a common word of one of the languages, or one word in
``RARE`` by hash, so that texts without common words have spots as well - with
the chain of the next ``CHAIN`` content words within ``SPAN`` words.  A
document's fingerprint is its set of chains, as sorted 32-bit hashes; likeness
is the Jaccard coefficient of two sets.

``near_pairs`` is the join over all documents: classes of equal sets are
partitioned by set length so that only neighbouring partitions can match, meet
on the rare chains that any pair above the threshold must share, and are
compared only where the lengths still allow it.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import one_group
from ..session import write_through
from .common import NULL_ID, text_of

#: Common words of English, German, French and Spanish.
ANCHORS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "not", "of", "on",
           "or", "that", "the", "this", "to", "was", "with",
           "als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht",
           "sich", "und", "von", "zu",
           "au", "aux", "avec", "ce", "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne",
           "par", "pas", "pour", "que", "qui", "sur", "un", "une",
           "al", "como", "con", "del", "el", "las", "lo", "los", "no", "para", "por", "se", "su", "y")
RARE = 16
CHAIN = 3
SPAN = 8
BLOCK_ROWS = 2000
MAX_BLOCKS = 1 << 16


def _chains(words: str) -> Column:
    """Sorted distinct chain hashes of an array column of words."""
    content = lambda y: ~y.isin(*ANCHORS)

    def chain(x: Column, i: Column) -> Column:
        c = F.slice(F.filter(F.slice(F.col(words), i + 2, SPAN), content), 1, CHAIN)
        return F.when((x.isin(*ANCHORS) | (F.pmod(F.hash(x), F.lit(RARE)) == 0)) & (F.size(c) > 0),
                      F.hash(F.array_join(c, " ")))

    return F.array_sort(F.array_distinct(F.filter(F.transform(words, chain), lambda h: h.isNotNull())))


def add_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the array<int> fingerprint ``name`` of the text column ``text``.

    A text without spots has the hash of its words as its only element, one
    without words the hash of the text, an empty text none.
    """
    w = f"_{name}_words"
    df = df.withColumn(w, F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    df = df.withColumn(name, _chains(w))
    whole = F.when(F.length(text) == 0, F.array().cast("array<int>")).when(F.size(w) == 0, F.array(F.hash(text))) \
        .otherwise(F.array(F.hash(F.array_join(w, " "))))
    return df.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(whole)).drop(w)


def as_text(fp: str) -> Column:
    """A fingerprint as a string: eight hex digits an element."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard coefficient of two fingerprints; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """(k_id, text, block, last, k_hash) and the number of blocks asked for; rows are dealt so that each block is a run of descending ids.

    Blocks hold about BLOCK_ROWS documents (their number is at most MAX_BLOCKS);
    a block also gets the first document of the next lower one (the lowest
    block that of the highest), marked ``last``, so that every document's
    successor is in its block.  The text moves once.
    """
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("k_id"), text_of(docs["text"]).alias("text"))
    ids = rows.select("k_id")
    n = max(1, min(MAX_BLOCKS, math.ceil(ids.count() / BLOCK_ROWS)))
    cut = ids.repartitionByRange(n, "k_id").groupBy(F.spark_partition_id().alias("p")).agg(F.max("k_id").alias("top"))
    edges = sorted({float(r["top"]) for r in cut.collect()})[:-1]           # fewer than MAX_BLOCKS numbers
    blocks = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="key", outputCol="block") if edges else None

    def place(df: DataFrame) -> DataFrame:
        if blocks is None:
            return df.withColumn("block", one_group("k_id"))
        df = blocks.transform(df.withColumn("key", F.col("k_id").cast("double")))
        return df.withColumn("block", F.col("block").cast("int")).drop("key")

    tops = place(ids).groupBy("block").agg(F.max("k_id").alias("top"))
    above = F.lead("block").over(Window.orderBy("block"))
    tops = tops.withColumn("to", F.coalesce(above, F.min("block").over(Window.partitionBy())))
    tops = write_through(tops, "spot-blocks")
    placed = place(rows).join(F.broadcast(tops), "block").withColumn("k_hash", F.xxhash64("text")) \
        .withColumn("at", F.explode(F.when(F.col("k_id") == F.col("top"),
                                           F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("last")),
                                                   F.struct(F.col("to").alias("b"), F.lit(1).alias("last"))))
                                    .otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("last")))))) \
        .select("k_id", "k_hash", "text", F.col("at.b").alias("block"), F.col("at.last").alias("last"))
    return placed, n


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The next document is the one with the next lower
    doc_id (after the lowest the highest); rows of one id follow each other in
    the order of their texts' hashes, a null id is lowest.  Null text counts as
    empty.  An empty table gives an empty result; other columns are ignored.
    """
    rows, blocks = neighbours(docs)
    rows = rows.repartition("block")
    rows = add_fingerprint(rows, "text", "fp")
    w = Window.partitionBy("block").orderBy("last", F.desc("k_id"), "k_hash")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).filter("last = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")) \
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                                       F.substring("next_text", F.lit(1), half)))
    rows = add_fingerprint(rows.drop("text", "next_text"), "edited", "edited_fp")
    return rows.select(F.when(F.col("k_id") != F.lit(NULL_ID), F.col("k_id")).alias("doc_id"), "n_chars",
                       F.sha2("edited", 256).alias("edited_sha256"), as_text("fp").alias("fingerprint"),
                       as_text("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"),
                       likeness("fp", "next_fp").alias("near_next")).coalesce(blocks)      # no more tasks than blocks


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes a < b with their likeness, membership doc_id -> class).

    Classes are equal fingerprints, so copies are not expanded into pairs.
    Texts with an empty fingerprint match nothing.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text"))
    rows = add_fingerprint(rows, "text", "fp").withColumn("cls", F.xxhash64("fp")).select("doc_id", "cls", "fp")
    rows = write_through(rows, "spot-rows")
    sets = write_through(rows.filter(F.size("fp") > 0).groupBy("cls").agg(F.first("fp").alias("fp"))
                         .withColumn("n", F.size("fp")), "spot-sets")
    spots = sets.select("cls", "n", F.explode("fp").alias("spot"))
    often = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    # A pair above the threshold shares one of each set's rarest n - ceil(t n) + 1 spots (spots seen once come first).
    ranked = spots.join(often, "spot", "left").withColumn("often", F.coalesce("often", F.lit(1))) \
        .withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("often", "spot")))
    prefix = ranked.filter((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & (F.col("often") > 1))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold))).cast("int")
    prefix = write_through(prefix.withColumn("band", band).select("cls", "n", "r", "spot", "band"), "spot-prefix")
    x = prefix.select("spot", "band", *[F.col(c).alias(c + "a") for c in ("cls", "n", "r")])
    y = prefix.withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1))) \
        .select("spot", "band", *[F.col(c).alias(c + "b") for c in ("cls", "n", "r")])
    # Pruned: the shorter set must be long enough, and what is left of both sets after this spot must suffice.
    least = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb"))
    cand = x.join(y, ["spot", "band"]).filter(
        (F.col("clsa") < F.col("clsb")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
        & (F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + F.least("ra", "rb") >= least - 1e-9)) \
        .select("clsa", "clsb").distinct()
    side = lambda s: sets.select(F.col("cls").alias("cls" + s), F.col("fp").alias("fp" + s))
    pairs = cand.join(side("a"), "clsa").join(side("b"), "clsb").withColumn("likeness", likeness("fpa", "fpb")) \
        .filter(F.col("likeness") >= threshold).select(F.col("clsa").alias("a"), F.col("clsb").alias("b"), "likeness")
    return pairs, rows.select("doc_id", F.col("cls").alias("class"))
