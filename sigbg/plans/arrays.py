"""Array, nested-structure and token-dictionary studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, sql_hash_bucket
from ..operators import nested
from ..session import write_through
from ..sources.fixtures import CAND_SQL, EVT_SQL, VEC_SQL, cand, evt, vec, with_views
from ..sources.tables import read_table
from .registry import register

CAND = with_views(CAND_SQL)
EVT = with_views(EVT_SQL)
VEC = with_views(VEC_SQL)

N_BLOCKS = 4


@register("a1_a2_assemble_unpack", CAND + """
SELECT labels, CAST(l_quantity AS DOUBLE) AS f_quantity, CAST(l_discount AS DOUBLE) AS f_discount,
       CAST(l_tax AS DOUBLE) AS f_tax FROM cand""")
def a1_a2(spark, sf):
    c = cand(spark, sf)
    v = nested.assemble(c, ["l_quantity", "l_discount", "l_tax"], out="raw", vector=True)
    return nested.unpack(v, "raw", ["f_quantity", "f_discount", "f_tax"], keep=["labels"])


@register("a3_reshape", VEC + """
SELECT vec_id, [CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[17:32] AS DOUBLE[]),
                CAST(embedding[33:48] AS DOUBLE[]), CAST(embedding[49:64] AS DOUBLE[])] AS particles
FROM vec""")
def a3_reshape(spark, sf):
    v = vec(spark, sf)
    return v.select("vec_id", nested.reshape(F.col("embedding").cast("array<double>"), N_BLOCKS).alias("particles"))


_A4_SQL = (VEC + """,
p AS (SELECT vec_id, [CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[17:32] AS DOUBLE[]),
                      CAST(embedding[33:48] AS DOUBLE[]), CAST(embedding[49:64] AS DOUBLE[])] AS particles FROM vec),
m AS (SELECT avg(particles[1][1]) AS m0, avg(particles[2][1]) AS m1, avg(particles[3][1]) AS m2,
             avg(particles[4][1]) AS m3 FROM p WHERE {train}),
o AS (SELECT list_transform(list_sort([{'m': m0, 'i': 0}, {'m': m1, 'i': 1}, {'m': m2, 'i': 2}, {'m': m3, 'i': 3}]),
                            lambda s: s.i) AS ord FROM m)
SELECT vec_id, list_transform(ord, lambda i: particles[i + 1]) AS particles FROM p, o""").replace("{train}", f"{sql_hash_bucket(42, 'vec_id')} < 9000")


@register("a4_order_blocks", _A4_SQL)
def a4_order_blocks(spark, sf):
    v = vec(spark, sf)
    p = v.select("vec_id", nested.reshape(F.col("embedding").cast("array<double>"), N_BLOCKS).alias("particles"))
    train = p.filter(hash_bucket(42, "vec_id") < 9000)
    means = nested.block_means(train, "particles", momentum_index=0)
    return nested.order_blocks(p, "particles", means)


@register("a5_object_pairs", VEC + """,
p AS (SELECT vec_id, [CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[17:32] AS DOUBLE[]),
                      CAST(embedding[33:48] AS DOUBLE[]), CAST(embedding[49:64] AS DOUBLE[])] AS o FROM vec)
SELECT vec_id, list_transform(list_filter(range(16), lambda t: t // 4 <> t % 4),
                              lambda t: list_concat(o[t // 4 + 1], o[t % 4 + 1])) AS pairs FROM p""")
def a5_object_pairs(spark, sf):
    v = vec(spark, sf)
    objs = nested.reshape(F.col("embedding").cast("array<double>"), N_BLOCKS)
    return v.select("vec_id", nested.object_pairs(objs).alias("pairs"))


@register("a8_pick_element", VEC + """
SELECT vec_id, label, CAST(embedding[label + 1] AS DOUBLE) AS picked FROM vec""")
def a8_pick_element(spark, sf):
    v = vec(spark, sf)
    return v.select("vec_id", "label", nested.pick(F.col("embedding"), F.col("label")).cast("double").alias("picked"))


def _texts(spark, sf):
    d = read_table(spark, sf, "documents", ["text"])
    c = read_table(spark, sf, "conversations", ["text"])
    return d.unionByName(c)


_CHARS_SQL = """
WITH t AS (SELECT text FROM documents WHERE text IS NOT NULL AND length(text) > 0
           UNION ALL SELECT text FROM conversations WHERE text IS NOT NULL AND length(text) > 0),
c AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM t),
g AS (SELECT ch, COUNT(*) AS n FROM c GROUP BY ch)"""


@register("a7_char_dictionary", _CHARS_SQL + """
SELECT ch, CAST(dense_rank() OVER (ORDER BY ch) - 1 AS INTEGER) AS ix, n FROM g""")
def a7_char_dictionary(spark, sf):
    return nested.char_dictionary(_texts(spark, sf))


@register("a7_encode_check", """
WITH t AS (SELECT 'documents' AS src, doc_id AS id, CAST(0 AS BIGINT) AS turn, text FROM documents WHERE text IS NOT NULL AND length(text) > 0
           UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations WHERE text IS NOT NULL AND length(text) > 0),
x AS (SELECT src, id, turn, regexp_extract_all(text, '(?s).') AS chs FROM t),
c AS (SELECT src, id, turn, unnest(chs) AS ch, unnest(range(len(chs))) AS pos FROM x),
d AS (SELECT ch, CAST(dense_rank() OVER (ORDER BY ch) - 1 AS BIGINT) AS ix FROM (SELECT DISTINCT ch FROM c))
SELECT src, id, turn, COUNT(*) AS n_codes, CAST(SUM(ix * (pos % 97 + 1)) AS BIGINT) AS weighted_codes, TRUE AS decodes
FROM c JOIN d USING (ch) GROUP BY src, id, turn""")
def a7_encode_check(spark, sf):
    """Both text tables, encoded and decoded again; the sum weighs codes by their place."""
    dic = write_through(nested.char_dictionary(_texts(spark, sf)), "char-dictionary")     # read twice
    docs = read_table(spark, sf, "documents", ["doc_id", "text"]).select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), "text")
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn", "text"]).select(
        F.lit("conversations").alias("src"), F.col("conv_id").alias("id"), "turn", "text")
    both = docs.unionByName(conv).filter(F.col("text").isNotNull() & (F.length("text") > 0))
    enc = nested.decode_text(nested.encode_text(both, dic), dic, out="back")
    terms = F.transform("codes", lambda ix, pos: ix.cast("bigint") * (pos % 97 + 1))
    return enc.select("src", "id", "turn", F.size("codes").cast("bigint").alias("n_codes"),
                      F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("weighted_codes"),
                      (F.col("back") == F.col("text")).alias("decodes"))


@register("p9_split_by_true_class", EVT + """
SELECT event_id, CAST(labels AS INTEGER) AS true_class, round(1.0 - score, 9) AS score_0, round(score, 9) AS score_1 FROM evt""")
def p9_split_by_true_class(spark, sf):
    """Every row under its true class with the score column of each class."""
    e = evt(spark, sf).withColumn("y", nested.one_hot("labels", 2))
    t = e.withColumn("true_class", nested.class_from_one_hot("y"))
    return t.select("event_id", "true_class", F.round(F.lit(1.0) - F.col("score"), 9).alias("score_0"), F.round("score", 9).alias("score_1"))
