"""Histogram studies, selections and tail truncation on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, sql_hash_bucket
from ..functions.scalar import logit
from ..operators import hist
from ..sources.fixtures import CAND_SQL, EVT_SQL, cand, evt, with_views
from .registry import register
from .sqlgen import hist_ctes, hist_select, hist_sql, trunc_cte

CAND = with_views(CAND_SQL)
EVT = with_views(EVT_SQL)


@register("h1_hist", hist_sql(CAND, "cand", "mbc", 50), headline=True)
def h1_hist(spark, sf):
    return hist.histogram(cand(spark, sf), "mbc", 50)


@register("h2_weighted_hist", hist_sql(CAND, "cand", "score", 50, by=["labels"]))
def h2_weighted_hist(spark, sf):
    return hist.histogram(cand(spark, sf), "score", 50, by=["labels"])


@register("h3_overlay", hist_sql(EVT, "evt_tr", "value", 40, by=["channel"], shared=False,
                                 extra_ctes=trunc_cte("evt_tr", "evt", "value", 5.0, ["channel"])))
def h3_overlay(spark, sf):
    t = hist.truncate_tails(evt(spark, sf), "value", 5.0, by=["channel"])
    return hist.histogram(t, "value", 40, by=["channel"], shared=False)


# H4 splits the candidates 90/10 by a hash of their own columns.
_TT_SRC = f"""tt AS (SELECT CASE WHEN {sql_hash_bucket(42, 'l_orderkey', 'l_linenumber', 'l_quantity')} < 9000
                    THEN 'train' ELSE 'test' END AS split, labels, score FROM cand)"""


def _tt_direct(spark, sf):
    c = cand(spark, sf)
    return c.select(F.when(hash_bucket(42, "l_orderkey", "l_linenumber", "l_quantity") < 9000, "train")
                    .otherwise("test").alias("split"), "labels", "score")


@register("h4_train_test", hist_sql(CAND, "tt", "score", 50, by=["split", "labels"], extra_ctes=_TT_SRC))
def h4_train_test(spark, sf):
    return hist.histogram(_tt_direct(spark, sf), "score", 50, by=["split", "labels"])


@register("h4_train_test_logit", hist_sql(CAND, "tt", "ln(score / (1.0 - score))", 50, by=["split", "labels"],
                                          extra_ctes=_TT_SRC))
def h4_train_test_logit(spark, sf):
    return hist.histogram(_tt_direct(spark, sf), logit("score"), 50, by=["split", "labels"])


@register("h5_score_hist", hist_sql(EVT, "evt", "score", 30, by=["labels"]))
def h5_score_hist(spark, sf):
    return hist.histogram(evt(spark, sf), "score", 30, by=["labels"])


@register("h6_profile", EVT + """,
b AS (SELECT mbc AS _x, score AS _y FROM evt WHERE labels < 0.5),
st AS (SELECT CASE WHEN max(_x) = min(_x) THEN min(_x) - 0.5 ELSE min(_x) END AS L,
              CASE WHEN max(_x) = min(_x) THEN max(_x) + 0.5 ELSE max(_x) END AS H FROM b),
bb AS (SELECT LEAST(CAST(floor((_x - L) * (69.0 / (H - L))) AS INTEGER), 68) AS bin, _y, L, H FROM b, st)
SELECT bin, round(((L + bin * (H - L) / 69.0) + (L + (bin + 1) * (H - L) / 69.0)) / 2.0, 6) AS center,
       COUNT(*) AS n, round(avg(_y), 6) AS mean_y, round(var_pop(_y), 6) AS var_y,
       round(sqrt(var_pop(_y) / COUNT(*)), 6) AS stderr_y
FROM bb GROUP BY bin, L, H
""")
def h6_profile(spark, sf):
    e = evt(spark, sf)
    return hist.profile(e.filter(F.col("labels") < 0.5), "mbc", "score", 69)


@register("h7_efficiency", CAND + """,
d AS (SELECT labels, mbc AS _x, CAST(score < 0.5 AS INTEGER) AS _p FROM cand),
st AS (SELECT labels, CASE WHEN max(_x) = min(_x) THEN min(_x) - 0.5 ELSE min(_x) END AS L,
              CASE WHEN max(_x) = min(_x) THEN max(_x) + 0.5 ELSE max(_x) END AS H FROM d GROUP BY labels),
b AS (SELECT labels, LEAST(CAST(floor((_x - L) * (50.0 / (H - L))) AS INTEGER), 49) AS bin, _p
      FROM d JOIN st USING (labels)),
g AS (SELECT labels, bin, COUNT(*) AS nb, SUM(_p) AS na FROM b GROUP BY ALL),
grid AS (SELECT labels, L, H, CAST(range AS INTEGER) AS bin FROM st CROSS JOIN range(50))
SELECT grid.labels, grid.bin, round(((L + grid.bin * (H - L) / 50.0) + (L + (grid.bin + 1) * (H - L) / 50.0)) / 2.0, 6)
       AS center, CAST(COALESCE(nb, 0) AS BIGINT) AS n_before, CAST(COALESCE(na, 0) AS BIGINT) AS n_after,
       CASE WHEN COALESCE(nb, 0) > 0 THEN round(CAST(COALESCE(na, 0) AS DOUBLE) / nb, 6) END AS eff
FROM grid LEFT JOIN g ON grid.labels = g.labels AND grid.bin = g.bin
""")
def h7_efficiency(spark, sf):
    return hist.efficiency(cand(spark, sf), "mbc", F.col("score") < 0.5, 50, by=["labels"])


_H11_SRC = trunc_cte("fv", "fv_in", "mbc", 4.0, ["stage", "labels"])
_H11_IN = """fv_in AS (SELECT 'before' AS stage, labels, mbc FROM cand
                UNION ALL SELECT 'after' AS stage, labels, mbc FROM cand WHERE score < 0.5)"""


@register("h11_fit_variables", hist_sql(CAND, "fv", "mbc", 50, by=["stage", "labels"], shared=False,
                                        extra_ctes=_H11_IN + ",\n" + _H11_SRC))
def h11_fit_variables(spark, sf):
    c = cand(spark, sf)
    before = c.select(F.lit("before").alias("stage"), "labels", "mbc")
    after = c.filter(F.col("score") < 0.5).select(F.lit("after").alias("stage"), "labels", "mbc")
    t = hist.truncate_tails(before.unionByName(after), "mbc", 4.0, by=["stage", "labels"])
    return hist.histogram(t, "mbc", 50, by=["stage", "labels"], shared=False)


@register("p13_truncate_tails", EVT + ",\n" + trunc_cte("tr", "evt", "value", 5.0) + """
SELECT event_id, channel, value FROM tr
""")
def p13_truncate_tails(spark, sf):
    return hist.truncate_tails(evt(spark, sf), "value", 5.0).select("event_id", "channel", "value")


@register("p11_p12_score_cuts", CAND + """
SELECT labels, COUNT(*) AS n_all, CAST(SUM(CAST(score > 0.9 AS INTEGER)) AS BIGINT) AS n_tight,
       CAST(SUM(CAST(score < 0.5 AS INTEGER)) AS BIGINT) AS n_veto
FROM cand GROUP BY labels
""")
def p11_p12(spark, sf):
    c = cand(spark, sf)
    return c.groupBy("labels").agg(F.count(F.lit(1)).alias("n_all"),
                                   F.sum((F.col("score") > 0.9).cast("int")).cast("bigint").alias("n_tight"),
                                   F.sum((F.col("score") < 0.5).cast("int")).cast("bigint").alias("n_veto"))


@register("p14_p15_fit_window", CAND + """
SELECT l_orderkey, l_linenumber, mbc, deltae, round(ln(score / (1.0 - score)), 6) AS logit_score
FROM cand
WHERE score > 0.5 AND mbc BETWEEN 10000.0 AND 50000.0 AND deltae BETWEEN -0.05 AND 0.05
""")
def p14_p15(spark, sf):
    c = cand(spark, sf)
    acc = c.filter(F.col("score") > 0.5)
    win = acc.filter(F.col("mbc").between(10000.0, 50000.0) & F.col("deltae").between(-0.05, 0.05))
    return win.select("l_orderkey", "l_linenumber", "mbc", "deltae",
                      F.round(logit("score"), 6).alias("logit_score"))


@register("p16_m7_scored_weights", EVT + """,
n AS (SELECT labels, COUNT(*) AS N FROM evt GROUP BY labels)
SELECT event_id, labels, round(score, 9) AS score, round(1.0 / N, 12) AS weight FROM evt JOIN n USING (labels)
""")
def p16_m7(spark, sf):
    e = hist.unit_weights(evt(spark, sf))
    return e.select("event_id", "labels", F.round("score", 9).alias("score"), F.round("weight", 12).alias("weight"))


__all__ = ["hist_ctes", "hist_select"]
