"""Histograms, profiles, efficiencies and tail truncation.

Edges come from one-row aggregates used as scalar subqueries (shared edges)
or from a per-group aggregate joined back (one row per group; the table itself
is not shuffled for it, and null is a group like any other).  Counting is a partial aggregate on (group, bin); the
full bin grid is generated from the edge rows, so empty bins appear with a
zero count as in ``np.histogram``.  No data is ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import join_group_stats, nullsafe_join


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _valid(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def edge_stats(d: DataFrame, by: Sequence[str], shared: bool, lo=None, hi=None) -> DataFrame | tuple:
    """Edges of a histogram.

    Fixed range -> (L, H) literal columns; shared edges -> (struct scalar
    subquery with L0/H0, None), to be bound to a column once; per-group
    edges -> a DataFrame (by..., _L, _H) joined back (one row per group).
    """
    if lo is not None and hi is not None:
        return F.lit(float(lo)), F.lit(float(hi))
    if shared or not by:
        # One struct-valued scalar subquery, bound once per frame by the caller.
        st = d.agg(F.struct(F.min("_x").alias("L0"), F.max("_x").alias("H0")).alias("s")).scalar()
        return st, None
    st = d.groupBy(*by).agg(F.min("_x").alias("_L0"), F.max("_x").alias("_H0"))
    return st.select(*by,
                     F.when(F.col("_H0") == F.col("_L0"), F.col("_L0") - 0.5).otherwise(F.col("_L0")).alias("_L"),
                     F.when(F.col("_H0") == F.col("_L0"), F.col("_H0") + 0.5).otherwise(F.col("_H0")).alias("_H"))


def bin_index(x: Column, L: Column, H: Column, nbins: int) -> Column:
    """H1 bin rule: floor((x-L) * (n/(H-L))), last bin closed."""
    b = F.floor((x - L) * (F.lit(float(nbins)) / (H - L))).cast("int")
    return F.least(b, F.lit(nbins - 1))


def histogram(df: DataFrame, x, nbins: int = 50, by: Sequence[str] = (), shared: bool = True,
              lo: float | None = None, hi: float | None = None, places: int = 6) -> DataFrame:
    """H1/H2/H5: equal-width histogram with centres, counts, unit-area fractions and densities.

    Columns: by..., bin, lo_edge, hi_edge, center, n, frac (= n/N, the sum of
    1/N weights of H2), density (= n/(N*width)).
    """
    by = list(by)
    d = df.select(*by, _c(x).cast("double").alias("_x"))
    d = d.filter(_valid(F.col("_x")))
    if lo is not None and hi is not None:
        d = d.filter((F.col("_x") >= lo) & (F.col("_x") <= hi))
    st = edge_stats(d, by, shared, lo, hi)
    if isinstance(st, tuple):
        sub, _ = st
        if _ is None:
            L0, H0 = F.col("_st.L0"), F.col("_st.H0")
            L = F.when(H0 == L0, L0 - F.lit(0.5)).otherwise(L0)
            H = F.when(H0 == L0, H0 + F.lit(0.5)).otherwise(H0)
            d = d.withColumn("_st", sub)
        else:
            L, H = st
        binned = d.select(*by, bin_index(F.col("_x"), L, H, nbins).alias("bin"))
        groups = d.select(*by).distinct() if by else d.agg(F.count(F.lit(1)).alias("_c")).filter("_c > 0")
        if _ is None:
            groups = groups.withColumn("_st", sub)
        grid = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"),
                             L.alias("_L"), H.alias("_H"))
    else:
        binned = join_group_stats(d, st, by).select(*by, bin_index(F.col("_x"), F.col("_L"), F.col("_H"), nbins)
                                                .alias("bin"))
        grid = st.select(*by, F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"), "_L", "_H")
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("_n"))
    out = nullsafe_join(grid, counts, by + ["bin"], "left").withColumn("n", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    width = (F.col("_H") - F.col("_L")) / F.lit(float(nbins))
    lo_e = F.col("_L") + F.col("bin") * (F.col("_H") - F.col("_L")) / F.lit(float(nbins))
    hi_e = F.col("_L") + (F.col("bin") + 1) * (F.col("_H") - F.col("_L")) / F.lit(float(nbins))
    N = F.sum("n").over(w)
    return out.select(*by, "bin", F.round(lo_e, places).alias("lo_edge"), F.round(hi_e, places).alias("hi_edge"),
                      F.round((lo_e + hi_e) / F.lit(2.0), places).alias("center"), "n",
                      F.round(F.col("n") / N, 9).alias("frac"),
                      F.round(F.col("n") / (N * width), places).alias("density"))


def truncate_tails(df: DataFrame, x: str, nsigma: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Drop x <= mean - n*std, then x >= mean' + n*std' on the survivors.

    Population std; strict inequalities; the upper cut re-estimates the
    moments after the lower cut, as the reference does.  Moments are scalar
    subqueries (or a per-group aggregate joined back).
    """
    by = list(by)
    xc = F.col(x)
    if not by:
        cols = df.columns
        st0 = df.agg(F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias("s")).scalar()
        t1 = df.withColumn("_m0", st0).filter(xc > F.col("_m0.m") - F.lit(float(nsigma)) * F.col("_m0.s")) \
               .select(*cols)
        st1 = t1.agg(F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias("s")).scalar()
        return t1.withColumn("_m1", st1).filter(xc < F.col("_m1.m") + F.lit(float(nsigma)) * F.col("_m1.s")) \
                 .select(*cols)
    st0 = df.groupBy(*by).agg(F.avg(x).alias("_m0"), F.stddev_pop(x).alias("_s0"))
    t1 = join_group_stats(df, st0, by).filter(xc > F.col("_m0") - F.lit(float(nsigma)) * F.col("_s0")) \
           .drop("_m0", "_s0")
    st1 = t1.groupBy(*by).agg(F.avg(x).alias("_m1"), F.stddev_pop(x).alias("_s1"))
    return join_group_stats(t1, st1, by).filter(xc < F.col("_m1") + F.lit(float(nsigma)) * F.col("_s1")) \
             .drop("_m1", "_s1")


def unit_weights(df: DataFrame, label: str = "labels", name: str = "weight") -> DataFrame:
    """M7: weight 1/N_class per row (class sizes are a per-class aggregate, joined back)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_N"))
    return join_group_stats(df, n, [label]).withColumn(name, F.lit(1.0) / F.col("_N")).drop("_N")


def profile(df: DataFrame, x, y, nbins: int = 69, places: int = 6) -> DataFrame:
    """H6: per equal-width x bin, n, mean(y), population variance and standard error of y."""
    d = df.select(_c(x).cast("double").alias("_x"), _c(y).cast("double").alias("_y")) \
          .filter(_valid(F.col("_x")) & F.col("_y").isNotNull())
    sub, _ = edge_stats(d, [], True)
    d = d.withColumn("_st", sub)
    L0, H0 = F.col("_st.L0"), F.col("_st.H0")
    L = F.when(H0 == L0, L0 - F.lit(0.5)).otherwise(L0)
    H = F.when(H0 == L0, H0 + F.lit(0.5)).otherwise(H0)
    b = d.select(bin_index(F.col("_x"), L, H, nbins).alias("bin"), "_y", L.alias("_L"), H.alias("_H"))
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("_m"), F.var_pop("_y").alias("_v"),
                             F.first("_L").alias("_L"), F.first("_H").alias("_H"))
    lo_e = F.col("_L") + F.col("bin") * (F.col("_H") - F.col("_L")) / F.lit(float(nbins))
    hi_e = F.col("_L") + (F.col("bin") + 1) * (F.col("_H") - F.col("_L")) / F.lit(float(nbins))
    return g.select("bin", F.round((lo_e + hi_e) / F.lit(2.0), places).alias("center"), "n",
                    F.round("_m", places).alias("mean_y"), F.round("_v", places).alias("var_y"),
                    F.round(F.sqrt(F.col("_v") / F.col("n")), places).alias("stderr_y"))


def efficiency(df: DataFrame, x: str, passed: Column, nbins: int = 50, by: Sequence[str] = ("labels",),
               places: int = 6) -> DataFrame:
    """H7: per class and bin of ``x``, passed / all, on the edges of the "before" set.

    Edges are per class from all rows of that class (the reference recomputed
    edges for the "after" set; here both share the before edges).  Null where
    a bin has no rows before the cut.
    """
    by = list(by)
    d = df.select(*by, F.col(x).cast("double").alias("_x"), passed.cast("int").alias("_p")) \
          .filter(_valid(F.col("_x")))
    st = edge_stats(d, by, shared=False)
    b = join_group_stats(d, st, by).select(*by, bin_index(F.col("_x"), F.col("_L"), F.col("_H"), nbins).alias("bin"),
                                       "_p")
    g = b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("_b"), F.sum("_p").alias("_a"))
    grid = st.select(*by, F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"), "_L", "_H")
    out = nullsafe_join(grid, g, by + ["bin"], "left")
    lo_e = F.col("_L") + F.col("bin") * (F.col("_H") - F.col("_L")) / F.lit(float(nbins))
    hi_e = F.col("_L") + (F.col("bin") + 1) * (F.col("_H") - F.col("_L")) / F.lit(float(nbins))
    before = F.coalesce(F.col("_b"), F.lit(0)).cast("bigint")
    after = F.coalesce(F.col("_a"), F.lit(0)).cast("bigint")
    return out.select(*by, "bin", F.round((lo_e + hi_e) / F.lit(2.0), places).alias("center"),
                      before.alias("n_before"), after.alias("n_after"),
                      F.when(before > 0, F.round(after / before, places)).alias("eff"))
