"""Mixing sources to target weights by systematic sampling (operator 8); DataFrame functions only.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share
``share`` times the words of all documents; no source gets more than ``cap``
times its own words, and what it can't take goes to the others by weight.  A
document's expected number of copies is its source's target over its source's
words.  Within a source the documents are put in order (classes of 16 words of
size, random within), their expected copies are prefix-summed, one offset is
added, and a document is emitted once for each integer boundary that its step
crosses.  Neighbours in the order have nearly equal sizes, so the words taken
come near the target.

Expected copies are fixed-point integers and every random number is an md5, so
reruns, retries and repartitioning give the same mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import running
from ..session import write_through
from .common import NULL_ID, row_key, text_of

UNIT = 1 << 28
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
CLASS_WORDS = 16
CLASSES = 4096
BLOCK_ROWS = 200_000


def sizes(docs: DataFrame) -> DataFrame:
    """(k_id, k_hash, source, src, size): words of each whole text; src is the source with null told apart."""
    kid, kh = row_key(docs)
    source = docs["source"].cast("string")
    return docs.select(kid.alias("k_id"), kh.alias("k_hash"), source.alias("source"),
                       F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("src"),
                       F.regexp_count(text_of(docs["text"]), F.lit(WORD)).cast("long").alias("size"))


def targets(rows: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(src, n_docs, source_size, target, step): one row per source.

    The windows run over one row per source, not over documents.
    """
    s = rows.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    i = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((i - 1) % len(weights) + 1).cast("int"))) \
        .withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("fill", F.col("most") / F.col("w"))
    by_fill = Window.orderBy("fill", "src")
    everything = Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0.0))) \
        .withColumn("w_left", F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))) \
        .withColumn("all", F.lit(share) * F.sum("source_size").over(everything)) \
        .withColumn("level", (F.col("all") - F.col("before")) / F.col("w_left"))
    # The first source that isn't full sets the level of all that aren't.
    open_ = F.col("fill") > F.col("level")
    s = s.withColumn("line", F.min(F.when(open_, F.struct("fill", "src", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.when(F.col("fill") <= F.col("line"), F.col("most"))
                     .when(F.col("line").isNull(), F.col("most")).otherwise(F.col("w") * F.col("line")))
    step = F.when(F.col("source_size") > 0,
                  F.floor(F.col("target") / F.col("source_size") * float(UNIT) + 0.5)).otherwise(0)
    return s.select("src", F.col("source_size").cast("long").alias("source_size"), "target",
                    step.cast("long").alias("step"))


def _md5_number(c):
    return F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long")      # 28 bits: 0 <= number < UNIT


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, k_id, k_hash.

    Null text has size 0, a null source is a source of its own.  Documents of
    size 0 are drawn like the others and take no words.  Repeated rows are
    separate documents.  Empty table: empty result.  Other columns are ignored.
    """
    rows = write_through(sizes(docs), "mix-sizes")
    src = write_through(targets(rows, share, cap, weights), "mix-targets")
    rows = rows.withColumn("cls", F.least(F.floor(F.col("size") / CLASS_WORDS), F.lit(CLASSES - 1)).cast("int")) \
        .withColumn("draw", F.md5(F.col("k_id").cast("string")))
    most = rows.groupBy("src", "cls").count().agg(F.max("count").alias("m")).first()["m"] or 0
    digits = 0
    while most > BLOCK_ROWS * 16 ** digits:
        digits += 1
    r = rows.join(src, "src") \
        .withColumn("block", F.concat(F.lpad(F.col("cls").cast("string"), 4, "0"), F.substring("draw", 1, digits))) \
        .withColumn("whole", F.floor(F.col("step") / UNIT)) \
        .withColumn("part", F.col("step") % UNIT)
    r = running(r, order=["cls", "draw", "k_id", "size", "k_hash"], values={"sum_before": F.col("part")},
                block="block", partition_by=["src"], inclusive=False)
    offset = _md5_number(F.concat(F.lit(seed + ":"), F.col("src")))
    before = (F.col("sum_before") + offset) % UNIT
    copies = F.col("whole") + F.when(before + F.col("part") >= UNIT, 1).otherwise(0)
    return r.withColumn("copies", copies.cast("long")).select(
        F.when(F.col("k_id") != F.lit(NULL_ID), F.col("k_id")).alias("doc_id"), "size", "source_size", "target",
        "copies", (F.col("size") * F.col("copies")).alias("taken"), "k_id", "k_hash")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT src, source, sum(size)::BIGINT AS source_size FROM d GROUP BY src, source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             2.0::DOUBLE * source_size AS most FROM s),
f AS (SELECT *, most / w AS fill FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                 - coalesce(sum(most) OVER (ORDER BY fill, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / (sum(w) OVER (ORDER BY fill, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM f),
n AS (SELECT *, min_by(level, fill) FILTER (WHERE fill > level) OVER () AS line FROM l),
t AS (SELECT src, source_size, CASE WHEN line IS NULL OR fill <= line THEN most ELSE w * line END AS target FROM n),
e AS (SELECT *, CASE WHEN source_size > 0
                     THEN floor(target / source_size * {float(UNIT)}::DOUBLE + 0.5)::BIGINT ELSE 0 END AS step FROM t),
p AS (SELECT doc_id, size, source_size, target, step, src,
             least(size // {CLASS_WORDS}, {CLASSES - 1}) AS cls FROM d JOIN e USING (src)),
r AS (SELECT *, coalesce(sum(step % {UNIT}) OVER (PARTITION BY src ORDER BY cls, md5(doc_id::VARCHAR), doc_id, size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sum_before FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (step // {UNIT} + CASE WHEN (sum_before + ('0x' || md5('mix:' || src)[1:7])::BIGINT) % {UNIT}
                                           + step % {UNIT} >= {UNIT} THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""
