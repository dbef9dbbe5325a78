"""Classifier-output studies on the fixture scores: ROC, AUC, scalar metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import decision, sigmoid
from ..operators import curves, metrics
from ..sources.fixtures import CAND_SQL, EVT_SQL, QUALITY_SQL, cand, evt, quality, with_views
from .registry import register
from .sqlgen import hist_ctes

CAND = with_views(CAND_SQL)
EVT = with_views(EVT_SQL)

def _rounded(df, *cols, places=9):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _curve(df):
    """Curve columns rounded for comparison with SQL."""
    places = {"threshold": 9, "tpr": 6, "fpr": 6, "sig_eff": 6, "bkg_rej": 6, "log_rej": 6}
    return df.withColumns({c: F.round(c, n) for c, n in places.items() if c in df.columns})


_ROC_SQL_BODY = """
c AS (SELECT {by_sel}score, SUM(labels)::BIGINT AS tp_s, SUM(1 - labels)::BIGINT AS fp_s
      FROM {src} GROUP BY {by_sel}score),
t AS (SELECT {by_sel}SUM(tp_s) AS P, SUM(fp_s) AS N FROM c {by_grp}),
r AS (SELECT {by_sel}score, tp_s, fp_s,
             SUM(tp_s) OVER (PARTITION BY {by_part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             SUM(fp_s) OVER (PARTITION BY {by_part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp
      FROM c)
"""


def _roc_sql(views: str, src: str, by: str | None = None) -> str:
    by_sel = f"{by}, " if by else ""
    by_grp = f"GROUP BY {by}" if by else ""
    by_part = by if by else "1"
    join = f"JOIN t USING ({by})" if by else "CROSS JOIN t"
    return views.rstrip() + ",\n" + _ROC_SQL_BODY.format(src=src, by_sel=by_sel, by_grp=by_grp,
                                                          by_part=by_part).strip() + f"""
SELECT {by_sel}round(score, 9) AS threshold, CAST(tp AS BIGINT) AS tp,
       CAST(fp AS BIGINT) AS fp, round(CAST(tp AS DOUBLE) / P, 6) AS tpr, round(CAST(fp AS DOUBLE) / N, 6) AS fpr
FROM r {join}
UNION ALL
SELECT {by_sel}CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE)
FROM t
"""


def _auc_sql(views: str, src: str, by: str | None = None) -> str:
    by_sel = f"{by}, " if by else ""
    by_grp = f"GROUP BY {by}" if by else ""
    by_part = by if by else "1"
    return views.rstrip() + ",\n" + _ROC_SQL_BODY.format(src=src, by_sel=by_sel, by_grp=by_grp,
                                                          by_part=by_part).strip() + f"""
SELECT {by_sel}CAST(SUM(tp_s) AS BIGINT) AS n_pos, CAST(SUM(fp_s) AS BIGINT) AS n_neg,
       round(SUM(fp_s * (tp - tp_s / 2.0)) / (CAST(SUM(tp_s) AS DOUBLE) * SUM(fp_s)), 9) AS auc
FROM r {by_grp}
"""


@register("k3_roc", _roc_sql(CAND, "cand"), headline=True)
def k3_roc(spark, sf):
    return _curve(curves.roc_curve(cand(spark, sf)))


@register("k3_roc_by_channel", _roc_sql(CAND, "cand", "channel"))
def k3_roc_by_channel(spark, sf):
    return _curve(curves.roc_curve(cand(spark, sf), by=["channel"]))


@register("k4_auc", _auc_sql(CAND, "cand"), headline=True)
def k4_auc(spark, sf):
    return _rounded(curves.auc(cand(spark, sf)), "auc")


@register("k4_auc_events", _auc_sql(EVT, "evt"))
def k4_auc_events(spark, sf):
    return _rounded(curves.auc(evt(spark, sf)), "auc")


@register("k5_eff_rej", _roc_sql(CAND, "cand").replace(
    "SELECT round(score, 9) AS threshold, CAST(tp AS BIGINT) AS tp,\n"
    "       CAST(fp AS BIGINT) AS fp, round(CAST(tp AS DOUBLE) / P, 6) AS tpr, round(CAST(fp AS DOUBLE) / N, 6) AS fpr",
    "SELECT round(score, 9) AS threshold,\n"
    "       round(CAST(tp AS DOUBLE) / P, 6) AS sig_eff, round(1.0 - CAST(fp AS DOUBLE) / N, 6) AS bkg_rej").replace(
    "SELECT CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE)",
    "SELECT CAST(NULL AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE)"))
def k5_eff_rej(spark, sf):
    return _curve(curves.efficiency_rejection(curves.roc_curve(cand(spark, sf))))


_K6_SQL = CAND.rstrip() + """,
long AS (
  SELECT 'fixed' AS model, labels, score FROM cand
  UNION ALL
  SELECT 'tax' AS model, labels,
         1.0 / (1.0 + exp(-round(10.0 * l_tax - 0.4, 6))) AS score
  FROM cand),
c AS (SELECT model, score, SUM(labels)::BIGINT AS tp_s, SUM(1 - labels)::BIGINT AS fp_s
      FROM long GROUP BY model, score),
t AS (SELECT model, SUM(tp_s) AS P, SUM(fp_s) AS N FROM c GROUP BY model),
r AS (SELECT model, score,
             SUM(tp_s) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             SUM(fp_s) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp
      FROM c),
pts AS (
  SELECT model, round(score, 9) AS threshold,
         CAST(tp AS DOUBLE) / P AS tpr, CAST(fp AS DOUBLE) / N AS fpr
  FROM r JOIN t USING (model)
  UNION ALL SELECT model, CAST(NULL AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE) FROM t)
SELECT model, threshold, round(tpr, 6) AS sig_eff, round(1.0 - fpr, 6) AS bkg_rej,
       CASE WHEN fpr > 0 THEN round(-log10(fpr), 6) END AS log_rej
FROM pts
"""


@register("k6_roc_models", _K6_SQL)
def k6_roc_models(spark, sf):
    c = cand(spark, sf)
    a = c.select(F.lit("fixed").alias("model"), "labels", "score")
    b = c.select(F.lit("tax").alias("model"), "labels",
                 sigmoid(F.round(F.lit(10.0) * F.col("l_tax") - F.lit(0.4), 6)).alias("score"))
    return _curve(curves.roc_by_model(a.unionByName(b)))


# Scores 1e-11 apart: the labels repeat in a pattern along the event number.
_CLOSE_SQL = EVT.rstrip() + """,
close AS (SELECT event_id, labels, 0.9::DOUBLE + event_id * 1e-11::DOUBLE AS score FROM evt)"""


def _close(spark, sf):
    return evt(spark, sf).select("event_id", "labels", (F.lit(0.9) + F.col("event_id") * F.lit(1e-11)).alias("score"))


@register("k4_auc_close_scores", _CLOSE_SQL + """,
r AS (SELECT labels, CAST(rank() OVER (ORDER BY score) AS DOUBLE) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM close),
s AS (SELECT SUM(CASE WHEN labels = 1 THEN rk END) AS rs, CAST(SUM(labels) AS BIGINT) AS p, CAST(SUM(1 - labels) AS BIGINT) AS n FROM r)
SELECT p AS n_pos, n AS n_neg, round((rs - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n), 9) AS auc FROM s""")
def k4_auc_close_scores(spark, sf):
    return _rounded(curves.auc(_close(spark, sf)), "auc")


@register("k3_roc_close_scores", _CLOSE_SQL + """
SELECT (score - 0.9) * 1e11 AS nth, CAST(SUM(labels) OVER w AS BIGINT) AS tp, CAST(SUM(1 - labels) OVER w AS BIGINT) AS fp
FROM close WINDOW w AS (ORDER BY score DESC)""")
def k3_roc_close_scores(spark, sf):
    roc = curves.roc_curve(_close(spark, sf)).filter("threshold IS NOT NULL")
    return roc.select(((F.col("threshold") - F.lit(0.9)) * F.lit(1e11)).alias("nth"), "tp", "fp")


@register("g2_class_counts", CAND + """
SELECT labels, n, MIN(n) OVER () AS min_n, MAX(n) OVER () AS max_n
FROM (SELECT labels, COUNT(*) AS n FROM cand GROUP BY labels)
""")
def g2_class_counts(spark, sf):
    return metrics.class_counts(cand(spark, sf))


@register("g3_class_weight", with_views(QUALITY_SQL) + """
SELECT round(SUM(1.0 - labels) / SUM(CAST(labels AS DOUBLE)), 9) AS pos_weight FROM quality
""")
def g3_class_weight(spark, sf):
    return metrics.class_weight(quality(spark, sf))


_SCORE_METRICS_SQL = CAND + """
SELECT channel, COUNT(*) AS n,
       round(AVG(CAST(CAST(score > 0.5 AS INTEGER) = labels AS DOUBLE)), 9) AS accuracy,
       round(AVG(CAST(CAST(score > 0.5 AS INTEGER) <> labels AS DOUBLE)), 9) AS error_at_cut,
       round(AVG(-ln(greatest(CASE WHEN labels = 1 THEN score ELSE 1.0 - score END, 1e-15))), 9) AS log_loss
FROM cand GROUP BY channel
"""


@register("g4_g5_g6_score_metrics", _SCORE_METRICS_SQL)
def g456(spark, sf):
    return metrics.score_metrics(cand(spark, sf), by=["channel"])


@register("g7_masked_loss", CAND + """
SELECT round(AVG((1.0 - labels) * -ln(greatest(CASE WHEN labels = 1 THEN score ELSE 1.0 - score END, 1e-15))), 9)
       AS masked_loss
FROM cand
""")
def g7_masked_loss(spark, sf):
    return metrics.masked_loss(cand(spark, sf), metrics.row_log_loss())


@register("g9_hard_auc", CAND + """
SELECT round((AVG(CASE WHEN labels = 1 THEN CAST(score > 0.5 AS DOUBLE) END)
            + AVG(CASE WHEN labels = 0 THEN 1.0 - CAST(score > 0.5 AS DOUBLE) END)) / 2.0, 9) AS hard_auc
FROM cand
""")
def g9_hard_auc(spark, sf):
    return _rounded(curves.hard_auc(cand(spark, sf), pred=decision("score", 0.5)), "hard_auc")


@register("p8_p10_class_decision", EVT + """
SELECT labels, CAST(score > 0.5 AS INTEGER) AS pred, COUNT(*) AS n, round(SUM(mbc), 6) AS sum_mbc
FROM evt WHERE labels = 1 OR labels < 0.5 GROUP BY ALL
""")
def p8_p10(spark, sf):
    e = evt(spark, sf)
    both = metrics.signal(e).unionByName(metrics.background(e))
    return (both.withColumn("pred", decision("score", 0.5))
                .groupBy("labels", "pred").agg(F.count(F.lit(1)).alias("n"),
                                               F.round(F.sum("mbc"), 6).alias("sum_mbc")))


_DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("g1_describe", CAND + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std, "
    f"round(min({c}), 9) AS min, round(max({c}), 9) AS max FROM cand" for c in _DESCRIBE_COLS))
def g1_describe(spark, sf):
    # 9 places: means of 2-decimal data sit exactly on a 6-place rounding tie too often.
    return metrics.describe(cand(spark, sf), _DESCRIBE_COLS, places=9)


@register("g10_extents", CAND + """
SELECT min(mbc) AS mbc_min, max(mbc) AS mbc_max, min(deltae) AS deltae_min, max(deltae) AS deltae_max FROM cand""")
def g10_extents(spark, sf):
    return metrics.extents(cand(spark, sf), ["mbc", "deltae"])


@register("g11_per_channel", EVT + """
SELECT channel, COUNT(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value,
       round(avg(score), 9) AS mean_score, CAST(SUM(labels) AS BIGINT) AS n_signal
FROM evt GROUP BY channel""")
def g11_per_channel(spark, sf):
    return metrics.per_channel(evt(spark, sf), "channel", [
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"),
        F.round(F.stddev_pop("value"), 6).alias("std_value"), F.round(F.avg("score"), 9).alias("mean_score"),
        F.sum("labels").cast("bigint").alias("n_signal")])


def _channel_shape_stats(pdf):
    """Per channel: chi-square of its binned shape against the pooled shape (pandas, one small group)."""
    import numpy as np
    import pandas as pd
    n = pdf["n"].to_numpy(dtype="float64")
    p = pdf["p_all"].to_numpy(dtype="float64")
    tot = n.sum()
    exp = tot * p
    m = exp > 0
    chi2 = float(((n[m] - exp[m]) ** 2 / exp[m]).sum())
    order = np.lexsort((pdf["bin"].to_numpy(), -n))          # most populated bin, lowest index on ties
    return pd.DataFrame({"channel": [pdf["channel"].iloc[0]], "n": [int(tot)], "chi2": [round(chi2, 6)],
                         "ndf": [int(m.sum()) - 1], "mode_bin": [int(pdf["bin"].to_numpy()[order[0]])]})


@register("g11_per_channel_apply", EVT.rstrip() + ",\n" + hist_ctes("h", "evt", "value", 20, by=["channel"]) + """,
pa AS (SELECT bin, SUM(n) AS nb FROM h_out GROUP BY bin),
pt AS (SELECT SUM(nb) AS nt FROM pa),
j AS (SELECT h_out.channel, h_out.bin, h_out.n, CAST(pa.nb AS DOUBLE) / pt.nt AS p_all,
             SUM(h_out.n) OVER (PARTITION BY h_out.channel) AS tot
      FROM h_out JOIN pa ON h_out.bin = pa.bin CROSS JOIN pt),
r AS (SELECT channel, n, bin, row_number() OVER (PARTITION BY channel ORDER BY n DESC, bin) AS rk FROM h_out)
SELECT j.channel, CAST(MAX(tot) AS BIGINT) AS n,
       round(SUM(CASE WHEN tot * p_all > 0 THEN (n - tot * p_all) * (n - tot * p_all) / (tot * p_all) END), 6) AS chi2,
       CAST(SUM(CASE WHEN tot * p_all > 0 THEN 1 ELSE 0 END) - 1 AS BIGINT) AS ndf,
       CAST((SELECT r.bin FROM r WHERE r.channel = j.channel AND rk = 1) AS BIGINT) AS mode_bin
FROM j GROUP BY j.channel""")
def g11_per_channel_apply(spark, sf):
    """G11 custom path: a pandas function per channel, applied to the channel's
    histogram (at most ``nbins`` rows per group), never to its raw rows."""
    from ..operators import hist
    h = hist.histogram(evt(spark, sf), "value", 20, by=["channel"]).select("channel", "bin", "n")
    pooled = h.groupBy("bin").agg(F.sum("n").alias("nb"))
    pooled = pooled.withColumn("p_all", F.col("nb") / pooled.agg(F.sum("nb")).scalar()).select("bin", "p_all")
    j = h.join(pooled, "bin", "inner")
    return metrics.per_channel_apply(j, "channel", _channel_shape_stats,
                                     "channel string, n bigint, chi2 double, ndf bigint, mode_bin bigint")


@register("g11_group_function", EVT + """
SELECT channel, COUNT(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread,
       round((list(value ORDER BY value DESC))[1], 9) AS first, round((list(value ORDER BY value DESC))[2], 9) AS second,
       round((list(value ORDER BY value DESC))[3], 9) AS third
FROM evt WHERE value IS NOT NULL GROUP BY channel""")
def g11_group_function(spark, sf):
    """A custom function over a channel's raw rows by mergeable states."""
    from ..operators import groups
    g = groups.apply_mergeable(evt(spark, sf), "channel", ["value"], groups.moments_and_largest("value"),
                               "n bigint, mean double, spread double, largest array<double>")
    return g.select("channel", "n", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"),
                    *[F.round(F.get("largest", F.lit(i)), 9).alias(c) for i, c in enumerate(("first", "second", "third"))])
