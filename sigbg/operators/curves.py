"""ROC curves and areas (K3-K6).

The curve is built on the *distinct scores*, as they are: rows are first
reduced with a partial aggregate to one row per (group, score) carrying
(tp_s, fp_s), so the only data that is ever ordered is the set of distinct
scores, and its running sums use the blocked prefix helper -- no single-task
window over the full table.  Blocks come from an exact radix count of the
distinct scores, so saturated ones (many values within a hair of 0 or 1) spread
like any others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .blocks import value_blocks
from .prefix import join_group_stats, running


def score_counts(df: DataFrame, label: str = "labels", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score): tp_s, fp_s; rows without a score or label are left out.

    The curve reads this table several times (totals, block edges, block
    offsets, running sums, start points), so it is written once into the
    shared checkpoint folder; the source is scanned once, and a lost executor
    recomputes from the stored table.
    """
    y = F.col(label).cast("bigint")
    s = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    counts = (df.select(*by, (s + F.lit(0.0)).alias("score"), y.alias("_y")).filter("score IS NOT NULL AND _y IS NOT NULL")
                .groupBy(*by, "score")
                .agg(F.sum("_y").alias("tp_s"), F.sum(F.lit(1) - F.col("_y")).alias("fp_s")))
    return write_through(counts, "score-counts")


def cumulative_counts(counts: DataFrame, by: Sequence[str] = (), rows_per_block: int | None = None) -> DataFrame:
    """Descending running tp/fp over distinct scores (inclusive)."""
    blocked = value_blocks(counts, "score", rows_per_block)
    return running(blocked, order=["score"], values={"tp": "tp_s", "fp": "fp_s"},
                   block="_vblk", partition_by=by, descending=True)


def roc_curve(df: DataFrame, label: str = "labels", score: str = "score", by: Sequence[str] = (),
              rows_per_block: int | None = None) -> DataFrame:
    """K3: one row per distinct score (threshold) plus the (0,0) start point.

    Columns: [by...], threshold, tp, fp, tpr, fpr (threshold null for the start).
    """
    counts = score_counts(df, label, score, by)
    total = counts.groupBy(*by).agg(F.sum("tp_s").alias("P"), F.sum("fp_s").alias("N"))
    cum = cumulative_counts(counts, by, rows_per_block).select(*by, F.col("score").alias("threshold"), "tp", "fp")
    starts = total.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("tp"),
                          F.lit(0).cast("bigint").alias("fp"))
    if not by:
        starts = starts.filter(total.select(F.col("P").isNotNull()).scalar())       # no rows, no curve
    pts = cum.unionByName(starts)
    if by:
        pts = join_group_stats(pts, total, by)
    else:
        t = total.agg(F.struct(F.first("P").alias("P"), F.first("N").alias("N")).alias("t")).scalar()
        pts = pts.withColumn("_tot", t).withColumn("P", F.col("_tot.P")).withColumn("N", F.col("_tot.N"))
    return pts.select(*by, "threshold", F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
                      F.try_divide(F.col("tp"), F.col("P")).alias("tpr"), F.try_divide(F.col("fp"), F.col("N")).alias("fpr"))


def efficiency_rejection(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K5: signal efficiency (tpr) against background rejection (1 - fpr)."""
    return roc.select(*by, "threshold", F.col("tpr").alias("sig_eff"), (F.lit(1.0) - F.col("fpr")).alias("bkg_rej"))


def auc(df: DataFrame, label: str = "labels", score: str = "score", by: Sequence[str] = (),
        rows_per_block: int | None = None) -> DataFrame:
    """K4: trapezoidal area under the ROC = P(score+ > score-) + 0.5 P(tie).

    Sum over distinct scores of fp_s * (tp strictly above + tp_s / 2), / (P N).
    """
    cum = cumulative_counts(score_counts(df, label, score, by), by, rows_per_block)
    part = cum.groupBy(*by).agg(
        F.sum(F.col("fp_s") * (F.col("tp") - F.col("tp_s") / F.lit(2.0))).alias("_num"),
        F.sum("tp_s").alias("P"), F.sum("fp_s").alias("N"))
    return part.select(*by, F.col("P").cast("bigint").alias("n_pos"), F.col("N").cast("bigint").alias("n_neg"),
                       F.try_divide(F.col("_num"), F.col("P").cast("double") * F.col("N")).alias("auc"))


def roc_by_model(scored_long: DataFrame, model_col: str = "model", label: str = "labels",
                 score: str = "score") -> DataFrame:
    """K6: efficiency / rejection curves of several models in one table.

    Input is long form (model, label, score); curves are partitioned by model,
    and the log10 of the rejection factor 1/fpr is added for log-scale plots.
    """
    roc = roc_curve(scored_long, label, score, by=[model_col])
    return roc.select(model_col, "threshold", F.col("tpr").alias("sig_eff"), (F.lit(1.0) - F.col("fpr")).alias("bkg_rej"),
                      F.when(F.col("fpr") > 0, -F.log10(F.col("fpr"))).alias("log_rej"))


def hard_auc(df: DataFrame, label: str = "labels", pred: Column | str = "pred") -> DataFrame:
    """AUC of hard 0/1 predictions = (TPR + TNR) / 2 (balanced accuracy)."""
    p = F.col(pred) if isinstance(pred, str) else pred
    y = F.col(label)
    return df.agg(
        ((F.avg(F.when(y == 1, p.cast("double"))) +
          F.avg(F.when(y == 0, F.lit(1.0) - p.cast("double")))) / F.lit(2.0)).alias("hard_auc"))
