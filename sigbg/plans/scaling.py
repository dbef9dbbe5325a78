"""Score transforms and feature scaling studies."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions.hashing import hash_bucket, sql_hash_bucket
from ..operators import scale
from ..sources.fixtures import CAND_SQL, EVT_SQL, VEC_SQL, cand, evt, vec, with_views
from .registry import register

CAND = with_views(CAND_SQL)
EVT = with_views(EVT_SQL)
VEC = with_views(VEC_SQL)

# Fixed mixture used for the M9 density check (weights, means, sigmas).
GMM_W = (0.6, 0.4)
GMM_MU = (20.0, 100.0)
GMM_SD = (15.0, 60.0)


@register("m1_m2_logits", EVT + """
SELECT event_id, round(ln(score / (1.0 - score)), 9) AS logit,
       round(ln(score / (1.0 - score + 1e-8) + 1e-8), 9) AS guarded_logit FROM evt""")
def m1_m2_logits(spark, sf):
    e = evt(spark, sf)
    return e.select("event_id", F.round(sc.logit("score"), 9).alias("logit"),
                    F.round(sc.guarded_logit("score"), 9).alias("guarded_logit"))


_SCALE_COLS = ["l_quantity", "l_discount", "l_tax"]


@register("m4_standardise_pop", CAND + """,
s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md,
             stddev_pop(l_discount) AS sd, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM cand)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity,
       round((l_discount - md) / sd, 6) AS l_discount, round((l_tax - mt) / st, 6) AS l_tax FROM cand, s""")
def m4_standardise_pop(spark, sf):
    c = cand(spark, sf).select("l_orderkey", "l_linenumber", *_SCALE_COLS)
    s = scale.standardise_pop(c, _SCALE_COLS)
    return s.select("l_orderkey", "l_linenumber", *[F.round(x, 6).alias(x) for x in _SCALE_COLS])


@register("m5_standardise_train", EVT + f""",
sp AS (SELECT *, CASE WHEN {sql_hash_bucket(42, 'event_id')} < 9000 THEN 0 ELSE 1 END AS split FROM evt),
s AS (SELECT avg(value) AS mv, stddev_samp(value) AS sv, avg(CAST(user_id AS DOUBLE)) AS mu,
             stddev_samp(CAST(user_id AS DOUBLE)) AS su FROM sp WHERE split = 0)
SELECT event_id, split, round((value - mv) / sv, 6) AS value, round((CAST(user_id AS DOUBLE) - mu) / su, 6) AS user_id
FROM sp, s""")
def m5_standardise_train(spark, sf):
    e = evt(spark, sf).select("event_id", "value", "user_id") \
        .withColumn("split", F.when(hash_bucket(42, "event_id") < 9000, 0).otherwise(1))
    apply = scale.standardise_fit(e.filter(F.col("split") == 0), ["value", "user_id"])
    out = apply(e)
    return out.select("event_id", "split", F.round("value", 6).alias("value"), F.round("user_id", 6).alias("user_id"))


@register("m6_centre_maxabs", CAND + """,
m AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_tax) AS mt FROM cand),
c AS (SELECT l_orderkey, l_linenumber, l_quantity - mq AS q, l_discount - md AS d, l_tax - mt AS t FROM cand, m),
a AS (SELECT max(abs(q)) AS aq, max(abs(d)) AS ad, max(abs(t)) AS a_t FROM c)
SELECT l_orderkey, l_linenumber, round(q / aq, 6) AS l_quantity, round(d / ad, 6) AS l_discount,
       round(t / a_t, 6) AS l_tax FROM c, a""")
def m6_centre_maxabs(spark, sf):
    c = cand(spark, sf).select("l_orderkey", "l_linenumber", *_SCALE_COLS)
    s = scale.centre_maxabs(c, _SCALE_COLS)
    return s.select("l_orderkey", "l_linenumber", *[F.round(x, 6).alias(x) for x in _SCALE_COLS])


@register("m3_m8_a6_softmax_lse", VEC + """,
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM vec),
m AS (SELECT vec_id, a, list_max(a) AS mx FROM e),
s AS (SELECT vec_id, a, mx, list_sum(list_transform(a, lambda x: exp(x - mx))) AS se FROM m)
SELECT vec_id, round(mx + ln(se), 6) AS lse, CAST(list_position(a, mx) - 1 AS INTEGER) AS argmax,
       round(list_max(list_transform(a, lambda x: exp(x - mx) / se)), 6) AS sm_max,
       round(list_sum(list_transform(a, lambda x: exp(x - mx) / se)), 6) AS sm_sum
FROM s""")
def m3_m8_a6(spark, sf):
    v = vec(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    sm = sc.softmax("a")
    return v.select("vec_id", F.round(sc.log_sum_exp("a"), 6).alias("lse"), sc.argmax("a").alias("argmax"),
                    F.round(F.array_max(sm), 6).alias("sm_max"),
                    F.round(F.aggregate(sm, F.lit(0.0), lambda acc, x: acc + x), 6).alias("sm_sum"))


def _gmm_sql(x: str) -> str:
    terms = []
    for w, mu, s in zip(GMM_W, GMM_MU, GMM_SD):
        z = f"(({x} - {mu}) / {s})"
        terms.append(f"({math.log(w)!r} - {math.log(s)!r} - {0.5 * math.log(2 * 3.141592653589793)!r} - 0.5 * {z} * {z})")
    arr = "[" + ", ".join(terms) + "]"
    return f"list_max({arr}) + ln(list_sum(list_transform({arr}, lambda t: exp(t - list_max({arr})))))"


@register("m9_gmm_logpdf", EVT + f"""
SELECT event_id, round({_gmm_sql('value')}, 6) AS logpdf FROM evt""")
def m9_gmm_logpdf(spark, sf):
    e = evt(spark, sf)
    return e.select("event_id", F.round(sc.gmm_log_density("value", GMM_W, GMM_MU, GMM_SD), 6).alias("logpdf"))
