"""Working points, exact quantile bins, top-n and running bests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .blocks import value_blocks
from .hist import histogram
from .prefix import row_number, running


def rejection_working_point(df: DataFrame, key: str, label: str = "labels", score: str = "score",
                            rejection: float = 0.995) -> tuple[DataFrame, float | None]:
    """K1: the top ``int(n_bkg * (1 - rejection))`` background rows by score.

    Returns (post-cut background rows, threshold: the lowest score among them,
    None if none is kept).  Only distinct scores are ordered: a running count
    over them finds the score at which the number is reached; rows above it
    pass a filter, and of the rows that tie at it the ones with the smallest
    ``key`` are kept (pandas keeps the first occurrence).  Scores are compared
    as they are; rows without a score are never kept.
    """
    bkg = df.filter(F.col(label) < 0.5)
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    counts = write_through(bkg.select(value.alias("_s")).groupBy("_s").agg(F.count(F.lit(1)).alias("_c")), "working-point")
    n_bkg = counts.agg(F.sum("_c")).first()[0] or 0
    k = math.floor(n_bkg * (1.0 - float(rejection)))
    real = counts.filter("_s IS NOT NULL")
    cum = running(value_blocks(real, "_s"), order=["_s"], values={"_cum": "_c"}, block="_vblk", descending=True)
    # The score at which the number is reached, and how many of its ties are kept (one row each).
    at = cum.filter(F.col("_cum") >= k).agg(F.max(F.struct("_s", (F.lit(k) - F.col("_cum") + F.col("_c")).alias("need"))).alias("t")).first()["t"]
    if k == 0:
        return bkg.filter(F.lit(False)), None
    if at is None:                                       # fewer scored rows than asked for: all of them
        return bkg.filter(value.isNotNull()), real.agg(F.min("_s")).first()[0]
    above, ties = bkg.filter(value > F.lit(at["_s"])), bkg.filter(value == F.lit(at["_s"]))
    ties = write_through(ties, "working-point-ties")
    first = row_number(value_blocks(ties, key), order=[key], block="_vblk").filter(F.col("rn") <= at["need"]).drop("rn", "_vblk")
    return above.unionByName(first), at["_s"]


def global_rank(df: DataFrame, order: str, key: str, name: str = "rank", rows_per_block: int | None = None) -> DataFrame:
    """1-based place of every row in the order of (``order``, ``key``), nulls first; no task holds more than a block.

    Rows of one value of ``order`` are one block; ``key`` breaks its ties.
    """
    d = write_through(df, "global-rank")
    ranked = row_number(value_blocks(d, order, rows_per_block, "_gr_blk"), order=[order, key], block="_gr_blk", name="_gr")
    return ranked.withColumn(name, F.col("_gr").cast("bigint")).drop("_gr", "_gr_blk")


def working_point_summary(df: DataFrame, key: str, label: str = "labels", score: str = "score",
                          rejection: float = 0.995) -> DataFrame:
    """K1 summary row: threshold, background kept, signal kept (score > threshold), efficiencies."""
    post, thr = rejection_working_point(df, key, label, score, rejection)
    y = F.col(label)
    t = F.lit(thr).cast("double")
    s = df.agg(F.sum((y < 0.5).cast("bigint")).alias("n_bkg"), F.sum((y == 1).cast("bigint")).alias("n_sig"),
               F.sum(((y == 1) & (F.col(score) > t)).cast("bigint")).alias("n_sig_kept"))
    n_post = post.select(F.count(F.lit(1))).scalar()
    return s.select(t.alias("threshold"), "n_bkg", n_post.alias("n_bkg_kept"), "n_sig", "n_sig_kept",
                    F.try_divide(F.col("n_sig_kept"), F.col("n_sig")).alias("sig_eff"))


def sculpting_table(df: DataFrame, key: str, variable: str, label: str = "labels", score: str = "score",
                    rejection: float = 0.995, nbins: int = 50, signal: bool = True) -> DataFrame:
    """Density histograms of a pivot for background, background after the
    working-point cut and (optionally) signal before / after; each sample has
    its own edges, as each distribution is binned separately."""
    post, thr = rejection_working_point(df, key, label, score, rejection)
    parts = [df.filter(F.col(label) < 0.5).select(F.lit("bkg").alias("sample"), variable),
             post.select(F.lit("bkg_post").alias("sample"), variable)]
    if signal:
        sig = df.filter(F.col(label) == 1)
        parts += [sig.select(F.lit("sig").alias("sample"), variable),
                  sig.filter(F.col(score) > F.lit(thr).cast("double")).select(F.lit("sig_post").alias("sample"), variable)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return histogram(u, variable, nbins, by=["sample"], shared=False)


def exact_quantile_edges(df: DataFrame, x: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy / quantile_cont definition).

    The values are reduced to (distinct value, count), running counts are
    taken with the blocked prefix helper, and only the rows holding the
    needed order statistics (at most 2 per probability) are kept.  Memory
    does not depend on the number of distinct values, unlike ``percentile``.
    Result: one row per probability (p, q).
    """
    d = df.select(F.col(x).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    cnt = d.groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    cnt = write_through(cnt, "quantile-counts")         # read several times below: scan the source once
    n = cnt.select(F.sum("_c")).scalar()
    blocked = value_blocks(cnt, "_v")
    cum = running(blocked, order=["_v"], values={"_cum": "_c"}, block="_vblk")
    ps = F.array(*[F.lit(float(p)) for p in probs])
    t = cum.select("_v", (F.col("_cum") - F.col("_c")).alias("_lo_r"), F.col("_cum").alias("_hi_r"),
                   F.explode(ps).alias("p"))
    h = F.col("p") * (n - F.lit(1))
    t = t.withColumn("_h", h).withColumn("_fl", F.floor("_h")).withColumn("_ce", F.ceil("_h"))
    hit_lo = (F.col("_lo_r") <= F.col("_fl")) & (F.col("_fl") < F.col("_hi_r"))
    hit_hi = (F.col("_lo_r") <= F.col("_ce")) & (F.col("_ce") < F.col("_hi_r"))
    m = t.filter(hit_lo | hit_hi)
    g = m.groupBy("p").agg(F.max(F.when(hit_lo, F.col("_v"))).alias("_vlo"),
                           F.max(F.when(hit_hi, F.col("_v"))).alias("_vhi"),
                           F.first("_h").alias("_h"), F.first("_fl").alias("_fl"))
    return g.select("p", (F.col("_vlo") + (F.col("_h") - F.col("_fl")) * (F.col("_vhi") - F.col("_vlo"))).alias("q"))


def quantile_bins(df: DataFrame, x: str, q: int = 10, name: str | None = None) -> DataFrame:
    """K2: ``pd.qcut(x, q, labels=False)``: right-closed bins, lowest included.

    bin = number of inner edges strictly below x.  Duplicate edges raise, as
    in the reference.  The edge array is a one-row scalar subquery.
    """
    probs = [i / q for i in range(q + 1)]
    e = exact_quantile_edges(df, x, probs)
    edges = e.agg(F.array_sort(F.collect_list(F.struct("p", "q"))).alias("_e")) \
             .select(F.transform("_e", lambda s: s["q"]).alias("_e"))
    df = df.withColumn("_qe", edges.select("_e").scalar())
    arr = F.col("_qe")
    dup = F.size(F.array_distinct(arr)) < F.size(arr)
    # Count of inner edges below x, written as q-1 comparisons (a scalar
    # subquery may not appear inside a higher-order function).
    xv = F.col(x).cast("double")
    b = F.lit(0)
    for i in range(2, q + 1):
        b = b + (F.element_at(arr, i) < xv).cast("int")
    out = F.when(dup, F.raise_error(F.lit("quantile bin edges are not unique"))).otherwise(b).cast("int")
    return df.withColumn(name or f"{x}_bin", F.when(F.col(x).isNotNull(), out)).drop("_qe")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """K7: sort and keep n rows (per-partition top-n, then a merge: TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def running_best(runs: DataFrame, order: str, metric: str, block_size: int = 1024) -> DataFrame:
    """K8: best metric so far and the run that holds it (first run on ties)."""
    best = F.struct(F.col(metric).alias("m"), (-F.col(order)).alias("neg"))
    r = running(runs.withColumn("_b", best), order=[order], values={"_best": "_b"},
                block=F.floor(F.col(order) / F.lit(block_size)).cast("int"), how="max")
    return r.select("*", F.col("_best.m").alias("best_so_far"), (-F.col("_best.neg")).alias("leader")) \
            .drop("_b", "_best")
