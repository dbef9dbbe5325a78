"""Class counts and scalar metrics.

All are single-pass aggregates with map-side partial aggregation; the only
shuffle carries one partial row per task (or per group for ``by``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import decision
from .prefix import fixed_blocks, join_group_stats, running


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signal(df: DataFrame, label: str = "labels") -> DataFrame:
    """Signal rows, label == 1."""
    return df.filter(F.col(label) == 1)


def background(df: DataFrame, label: str = "labels") -> DataFrame:
    """Background rows, label < 0.5."""
    return df.filter(F.col(label) < 0.5)


def class_counts(df: DataFrame, label: str = "labels") -> DataFrame:
    """Count per class, plus the smallest and largest class size.

    The min/max window runs over the aggregated table (one row per class).
    """
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))
    return c.select(label, "n", F.min("n").over(w).alias("min_n"), F.max("n").over(w).alias("max_n"))


def class_weight(df: DataFrame, label: str = "labels") -> DataFrame:
    """scale_pos_weight = negatives / positives."""
    y = F.col(label).cast("double")
    return df.agg(F.round(F.try_divide(F.sum(F.lit(1.0) - y), F.sum(y)), 9).alias("pos_weight"))


def accuracy(df: DataFrame, pred: Column | str, truth: Column | str = "labels",
             name: str = "accuracy") -> DataFrame:
    """Mean of (prediction == truth)."""
    return df.agg(F.round(F.avg((_c(pred) == _c(truth)).cast("double")), 9).alias(name))


def score_metrics(df: DataFrame, label: str = "labels", score: str = "score", cut: float = 0.5,
                  by: Sequence[str] = ()) -> DataFrame:
    """G4 + G5 + G6 in one pass: accuracy, error@cut and log loss."""
    y = F.col(label)
    p = F.col(score)
    pred = decision(p, cut)
    p_true = F.when(y == 1, p).otherwise(F.lit(1.0) - p)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((pred == y).cast("double")), 9).alias("accuracy"),
        F.round(F.avg((pred != y).cast("double")), 9).alias("error_at_cut"),
        F.round(F.avg(-F.log(F.greatest(p_true, F.lit(1e-15)))), 9).alias("log_loss"),
    )


def row_log_loss(label: str = "labels", score: str = "score") -> Column:
    y = F.col(label)
    p = F.col(score)
    return -F.log(F.greatest(F.when(y == 1, p).otherwise(F.lit(1.0) - p), F.lit(1e-15)))


def masked_loss(df: DataFrame, loss: Column | str, label: str = "labels", mask: bool = True) -> DataFrame:
    """mean((1-y) * loss) over all rows (mask=True) or mean(loss)."""
    l = _c(loss)
    expr = (F.lit(1.0) - F.col(label).cast("double")) * l if mask else l
    return df.agg(F.round(F.avg(expr), 9).alias("masked_loss"))


def describe(df: DataFrame, cols: Sequence[str], places: int = 6) -> DataFrame:
    """G1: count / mean / std (sample) / min / max per column, long form.

    One aggregate pass over all columns, then a stack into (column, stat...)
    rows -- no per-column job.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    stack = "stack({}, {})".format(
        len(cols), ", ".join(f"'{c}', `{c}__count`, `{c}__mean`, `{c}__std`, `{c}__min`, `{c}__max`"
                             for c in cols))
    long = wide.selectExpr(f"{stack} as (column, count, mean, std, min, max)")
    return long.select("column", F.col("count").cast("bigint").alias("count"),
                       *[F.round(F.col(s), places).alias(s) for s in ("mean", "std", "min", "max")])


def extents(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per-column min / max (plot extents), one row."""
    return df.agg(*[a for c in cols for a in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])


def per_channel(df: DataFrame, channel: str, aggs: Sequence[Column]) -> DataFrame:
    """G11 (built-in path): groupBy(channel).agg(...)."""
    return df.groupBy(channel).agg(*aggs)


def per_channel_apply(df: DataFrame, channel: str, fn: Callable[[pd.DataFrame], pd.DataFrame],
                      schema: str) -> DataFrame:
    """G11 (custom path): arbitrary pandas function per channel.

    Only for functions that are not expressible as aggregates: each group is
    loaded into one Python worker, so use it when groups are bounded.
    """
    return df.groupBy(channel).applyInPandas(fn, schema=schema)


def epoch_losses(batch_losses: DataFrame, epoch: str = "epoch", step: str = "step",
                 loss: str = "loss", steps_per_block: int = 1024) -> DataFrame:
    """Running mean of batch losses within each epoch, and the epoch mean.

    Running sums per epoch use the blocked prefix helper (blocks of steps), so
    a long epoch is not one task.
    """
    b = F.floor(F.col(step) / F.lit(steps_per_block)).cast("int")
    r = running(batch_losses, order=[step], values={"_cs": F.col(loss), "_cn": F.lit(1).cast("bigint")},
                block=b, partition_by=[epoch])
    tot = batch_losses.groupBy(epoch).agg(F.avg(loss).alias("epoch_mean"))
    return (join_group_stats(r, tot, [epoch])
             .select(epoch, step, F.round(F.col(loss), 9).alias("loss"),
                     F.round(F.col("_cs") / F.col("_cn"), 9).alias("running_mean"),
                     F.round(F.col("epoch_mean"), 9).alias("epoch_mean")))


__all__ = ["signal", "background", "class_counts", "class_weight", "accuracy", "score_metrics",
           "row_log_loss", "masked_loss", "describe", "extents", "per_channel", "per_channel_apply",
           "epoch_losses", "fixed_blocks"]
