"""Feature scaling (M4-M6).

Moments are a single one-row aggregate used as ONE struct-valued scalar
subquery, so all columns are scaled from one pass over the data and no row
is ever joined to a broadcast table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _safe_scale(x: Column, scale: Column) -> Column:
    """x / scale, 0 where the scale is 0 (constant column), as the usual scalers do."""
    return F.when(scale == 0, F.lit(0.0)).otherwise(F.try_divide(x, scale))


def _stats(df: DataFrame, cols: Sequence[str], fns: dict) -> "F.Column":
    aggs = []
    for c in cols:
        for tag, fn in fns.items():
            aggs.append(fn(F.col(c).cast("double")).alias(f"{tag}__{c}"))
    return df.agg(F.struct(*aggs).alias("s")).scalar()


def standardise_pop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M4: (x - mean) / std_pop per column (scikit-learn StandardScaler semantics)."""
    out = df.withColumn("_st", _stats(df, cols, {"mu": F.avg, "sd": F.stddev_pop}))
    s = F.col("_st")
    for c in cols:
        out = out.withColumn(c, _safe_scale(F.col(c).cast("double") - s[f"mu__{c}"], s[f"sd__{c}"]))
    return out.drop("_st")


def standardise_fit(train: DataFrame, cols: Sequence[str]):
    """M5: fit mean / sample std on ``train``; returns a function applying them to any frame.

    Same numbers as ``ml.feature.StandardScaler(withMean=True, withStd=True)``
    (unbiased std), kept as columns instead of a vector.
    """
    s = _stats(train, cols, {"mu": F.avg, "sd": F.stddev_samp})

    def apply(df: DataFrame) -> DataFrame:
        out = df.withColumn("_st", s)
        for c in cols:
            out = out.withColumn(c, _safe_scale(F.col(c).cast("double") - F.col("_st")[f"mu__{c}"],
                                                F.col("_st")[f"sd__{c}"]))
        return out.drop("_st")
    return apply


def centre_maxabs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M6: subtract the mean, then divide by the max |x - mean| (range [-1, 1])."""
    centred = df.withColumn("_st", _stats(df, cols, {"mu": F.avg}))
    for c in cols:
        centred = centred.withColumn(c, F.col(c).cast("double") - F.col("_st")[f"mu__{c}"])
    centred = centred.drop("_st")
    out = centred.withColumn("_sm", _stats(centred, cols, {"ma": lambda x: F.max(F.abs(x))}))
    for c in cols:
        out = out.withColumn(c, _safe_scale(F.col(c), F.col("_sm")[f"ma__{c}"]))
    return out.drop("_sm")
