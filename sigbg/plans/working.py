"""Working points, quantile bins, top-n and running-best studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curves
from ..operators import working_point as wp
from ..operators.blocks import value_blocks
from ..operators.prefix import one_group
from ..session import write_through
from ..sources.fixtures import EVT_SQL, evt, with_views
from ..sources.tables import read_table
from .registry import register
from .sqlgen import hist_sql

EVT = with_views(EVT_SQL)
REJECTION = 0.95

def _rounded(df, *cols, places=9):
    return df.withColumns({c: F.round(c, places) for c in cols})


_POST = EVT.rstrip() + f""",
bk AS (SELECT * FROM evt WHERE labels < 0.5),
kk AS (SELECT floor(COUNT(*) * (CAST(1.0 AS DOUBLE) - CAST({REJECTION} AS DOUBLE))) AS k FROM bk),
post AS (SELECT bk.* FROM bk QUALIFY row_number() OVER (ORDER BY score DESC, event_id ASC) <= (SELECT k FROM kk)),
thr AS (SELECT min(score) AS thr FROM post)"""


@register("k1_working_point", _POST + """
SELECT round(thr, 9) AS threshold,
       (SELECT COUNT(*) FROM bk) AS n_bkg, (SELECT COUNT(*) FROM post) AS n_bkg_kept,
       (SELECT COUNT(*) FROM evt WHERE labels = 1) AS n_sig,
       (SELECT COUNT(*) FROM evt, thr WHERE labels = 1 AND score > thr.thr) AS n_sig_kept,
       round(CAST((SELECT COUNT(*) FROM evt, thr WHERE labels = 1 AND score > thr.thr) AS DOUBLE)
             / (SELECT COUNT(*) FROM evt WHERE labels = 1), 9) AS sig_eff
FROM thr""")
def k1_working_point(spark, sf):
    return _rounded(wp.working_point_summary(evt(spark, sf), "event_id", rejection=REJECTION), "threshold", "sig_eff")


@register("k1_close_scores", EVT.rstrip() + """,
bk AS (SELECT event_id, 0.9::DOUBLE + (event_id // 2) * 1e-11::DOUBLE AS score FROM evt WHERE labels < 0.5)
SELECT event_id FROM bk QUALIFY row_number() OVER (ORDER BY score DESC, event_id ASC) <= (SELECT floor(COUNT(*) * (CAST(1.0 AS DOUBLE) - CAST(0.95 AS DOUBLE))) FROM bk)""")
def k1_close_scores(spark, sf):
    """K1 on scores 1e-11 apart, two events to a score."""
    e = evt(spark, sf).withColumn("score", F.lit(0.9) + F.floor(F.col("event_id") / 2) * F.lit(1e-11))
    return wp.rejection_working_point(e, "event_id", rejection=REJECTION)[0].select("event_id")


@register("k1_global_rank", EVT + """SELECT event_id, row_number() OVER (ORDER BY value NULLS FIRST, event_id) AS rank FROM evt""")
def k1_global_rank(spark, sf):
    """Place of every event in the order of its value, over blocks of 200 rows."""
    return wp.global_rank(evt(spark, sf), "value", "event_id", rows_per_block=200).select("event_id", "rank")


@register("k2_block_edges", """
WITH c AS (SELECT l_extendedprice AS v, COUNT(*) AS n FROM lineitem GROUP BY ALL)
SELECT SUM(n)::BIGINT AS n_rows, COUNT(*) AS n_values, TRUE AS ordered, TRUE AS bounded FROM c""")
def k2_block_edges(spark, sf):
    """Blocks of at most 100 distinct prices: they hold all rows, follow each other in order, and none is overfull."""
    c = write_through(read_table(spark, sf, "lineitem", ["l_extendedprice"]).groupBy("l_extendedprice").agg(F.count(F.lit(1)).alias("n")), "prices")
    b = value_blocks(c, "l_extendedprice", 100).groupBy("_vblk").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    nxt = F.lead("lo").over(Window.partitionBy(one_group("_vblk")).orderBy("_vblk"))       # one row a block
    return b.withColumn("next", nxt).agg(F.sum("n").alias("n_rows"), F.sum("rows").alias("n_values"),
                                         F.min(F.coalesce(F.col("hi") < F.col("next"), F.lit(True))).alias("ordered"),
                                         (F.max("rows") <= 200).alias("bounded"))


_SCULPT_IN = """sc AS (
  SELECT 'bkg' AS sample, mbc FROM evt WHERE labels < 0.5
  UNION ALL SELECT 'bkg_post', mbc FROM post
  UNION ALL SELECT 'sig', mbc FROM evt WHERE labels = 1
  UNION ALL SELECT 'sig_post', mbc FROM evt, thr WHERE labels = 1 AND score > thr.thr)"""


@register("h12_sculpting", hist_sql(_POST, "sc", "mbc", 50, by=["sample"], shared=False, extra_ctes=_SCULPT_IN))
def h12_sculpting(spark, sf):
    return wp.sculpting_table(evt(spark, sf), "event_id", "mbc", rejection=REJECTION)


def _qedges_sql(src: str, x: str, name: str, q: int = 10) -> str:
    return f"""{name}_v AS (SELECT CAST({x} AS DOUBLE) AS _v FROM {src} WHERE {x} IS NOT NULL AND NOT isnan(CAST({x} AS DOUBLE))),
{name}_s AS (SELECT _v, row_number() OVER (ORDER BY _v) - 1 AS r FROM {name}_v),
{name}_n AS (SELECT COUNT(*) AS n FROM {name}_v),
{name}_h AS (SELECT p, p * (n - 1) AS h, floor(p * (n - 1)) AS fl, ceil(p * (n - 1)) AS ce
             FROM (SELECT CAST(range AS DOUBLE) / {q} AS p FROM range({q + 1})) ps, {name}_n),
{name}_e AS (SELECT p, lo._v + (h - fl) * (hi._v - lo._v) AS q
             FROM {name}_h JOIN {name}_s lo ON lo.r = fl JOIN {name}_s hi ON hi.r = ce),
{name}_arr AS (SELECT list(q ORDER BY p) AS e FROM {name}_e)"""


_K2_BIN = "CAST(len(list_filter(e[2:{last}], lambda v: v < CAST({x} AS DOUBLE))) AS INTEGER)"


@register("k2_quantile_bins", EVT.rstrip() + ",\n" + _qedges_sql("evt", "value", "qv") + f"""
SELECT {_K2_BIN.format(last=10, x='value')} AS value_bin, COUNT(*) AS n, min(value) AS min_value,
       max(value) AS max_value
FROM evt, qv_arr GROUP BY ALL""")
def k2_quantile_bins(spark, sf):
    b = wp.quantile_bins(evt(spark, sf), "value", 10, name="value_bin")
    return b.groupBy("value_bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"),
                                      F.max("value").alias("max_value"))


@register("k2_ancillary_bins", EVT.rstrip() + ",\n" + _qedges_sql("evt", "mbc", "qm") + ",\n"
          + _qedges_sql("evt", "deltae", "qd") + f"""
SELECT event_id, CAST(mbc AS FLOAT) AS mbc, CAST(deltae AS FLOAT) AS deltae,
       {_K2_BIN.format(last=10, x='mbc').replace('e[', 'qm_arr.e[')} AS mbc_labels,
       {_K2_BIN.format(last=10, x='deltae').replace('e[', 'qd_arr.e[')} AS dE_labels
FROM evt, qm_arr, qd_arr""")
def k2_ancillary_bins(spark, sf):
    e = evt(spark, sf)
    e = wp.quantile_bins(e, "mbc", 10, name="mbc_labels")
    e = wp.quantile_bins(e, "deltae", 10, name="dE_labels")
    return e.select("event_id", F.col("mbc").cast("float").alias("mbc"), F.col("deltae").cast("float").alias("deltae"),
                    "mbc_labels", "dE_labels")


@register("k7_top_n", EVT + """
SELECT event_id, channel, value FROM evt ORDER BY value DESC, event_id ASC LIMIT 20""")
def k7_top_n(spark, sf):
    return wp.top_n(evt(spark, sf).select("event_id", "channel", "value"),
                    [F.col("value").desc(), F.col("event_id").asc()], 20)


_K8_SQL = EVT.rstrip() + """,
d AS (SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, labels, score FROM evt),
c AS (SELECT day, score, SUM(labels)::BIGINT AS tp_s, SUM(1 - labels)::BIGINT AS fp_s FROM d GROUP BY ALL),
r AS (SELECT day, tp_s, fp_s, SUM(tp_s) OVER (PARTITION BY day ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp
      FROM c),
a AS (SELECT CAST(day AS INTEGER) AS day, round(SUM(fp_s * (tp - tp_s / 2.0)) / (CAST(SUM(tp_s) AS DOUBLE) * SUM(fp_s)), 9)
      AS auc FROM r GROUP BY day),
b AS (SELECT day, auc, MAX(auc) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS best_so_far FROM a)
SELECT day, auc, best_so_far,
       CAST((SELECT MIN(a2.day) FROM a a2 WHERE a2.day <= b.day AND a2.auc = b.best_so_far) AS INTEGER) AS leader
FROM b"""


@register("k8_running_best", _K8_SQL)
def k8_running_best(spark, sf):
    e = evt(spark, sf).withColumn("day", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("int"))
    runs = curves.auc(e, by=["day"]).select("day", F.round("auc", 9).alias("auc"))
    return wp.running_best(runs, "day", "auc").select("day", "auc", "best_so_far",
                                                     F.col("leader").cast("int").alias("leader"))


@register("g8_bin_accuracy", EVT.rstrip() + ",\n" + _qedges_sql("evt", "mbc", "qm") + f""",
st AS (SELECT min(mbc) AS L0, max(mbc) AS H0 FROM evt),
b AS (SELECT {_K2_BIN.format(last=10, x='mbc').replace('e[', 'qm_arr.e[')} AS true_bin,
             LEAST(CAST(floor((mbc - L0) * (10.0 / (H0 - L0))) AS INTEGER), 9) AS pred_bin
      FROM evt, qm_arr, st)
SELECT round(AVG(CAST(pred_bin = true_bin AS DOUBLE)), 9) AS bin_accuracy FROM b""")
def g8_bin_accuracy(spark, sf):
    """Accuracy of a predicted pivot bin (here equal-width bins) against the decile bin."""
    from ..operators import metrics
    from ..operators.hist import bin_index
    e = wp.quantile_bins(evt(spark, sf), "mbc", 10, name="true_bin")
    st = e.agg(F.struct(F.min("mbc").alias("L0"), F.max("mbc").alias("H0")).alias("s")).scalar()
    e = e.withColumn("_st", st).withColumn("pred_bin", bin_index(F.col("mbc"), F.col("_st.L0"), F.col("_st.H0"), 10))
    return metrics.accuracy(e, "pred_bin", "true_bin", name="bin_accuracy")
