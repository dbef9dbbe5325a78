"""Column roles, name-based pruning and correlation-driven feature selection.

P1-P7 (projections on column *names* and null rows) and C1-C8.  The
correlation matrix is kept in long form ``(a, b, a_pos, b_pos, r)`` with
one row per unordered pair (a_pos < b_pos); every selection rule is then a
filter / anti join on that small table.  Only lists of column names (bounded
by the schema width) ever reach the driver, because ``DataFrame.drop`` needs
them there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import guarded_logit

# Name patterns that mark column roles in the reference tables.
EXCLUDE_SUBSTRINGS = ("weight", "index")
FIT_VARIABLE_PATTERNS = ("mbc", "deltae")
BOOKKEEPING = ("nCands", "evtNum", "MCtype", "channel")
KEEP_PREFERENCE = "bo0"


@dataclass(frozen=True)
class Roles:
    """Column roles of an event table."""
    label: str = "labels"
    fit_vars: tuple[str, ...] = ("mbc", "deltae")
    exclude: tuple[str, ...] = BOOKKEEPING
    key: str | None = None
    extra_features: tuple[str, ...] = field(default_factory=tuple)

    def features(self, columns: Sequence[str]) -> list[str]:
        skip = {self.label, *self.fit_vars, *self.exclude}
        if self.key:
            skip.add(self.key)
        return [c for c in columns if c not in skip and "label" not in c]


# ------------------------------------------------------------------ P1-P7

def drop_containing(df: DataFrame, substrings: Iterable[str] = EXCLUDE_SUBSTRINGS) -> DataFrame:
    """Drop every column whose name contains any of the substrings."""
    subs = list(substrings)
    return df.drop(*[c for c in df.columns if any(s in c for s in subs)])


def prune_unwanted(df: DataFrame, unwanted: Iterable[str], label: str | None = None) -> DataFrame:
    """Keep columns containing none of ``unwanted``, in order, deduped, label first."""
    bad = list(unwanted)
    keep: list[str] = []
    for c in df.columns:
        if c != label and not any(b in c for b in bad) and c not in keep:
            keep.append(c)
    return df.select(*([label] if label else []), *keep)


def drop_suffix(df: DataFrame, suffix: str = "Err") -> DataFrame:
    """Drop columns whose name ends with ``suffix``."""
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def role_split(df: DataFrame, roles: Roles, features: Sequence[str] | None = None,
               dtype: str = "float") -> DataFrame:
    """(label int, fit variables, features array) with typed casts."""
    feats = list(features) if features is not None else roles.features(df.columns)
    cols = [F.col(roles.label).cast("int").alias("labels")]
    cols += [F.col(v).cast(dtype).alias(v) for v in roles.fit_vars if v in df.columns]
    if roles.key:
        cols.insert(0, F.col(roles.key))
    cols.append(F.array(*[F.col(c).cast(dtype) for c in feats]).alias("features"))
    return df.select(*cols)


def normalise_names(df: DataFrame, old: str = "__", new: str = "_") -> DataFrame:
    """Rename columns, ``__`` -> ``_``."""
    return df.toDF(*[c.replace(old, new) for c in df.columns])


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null or NaN."""
    return df.na.drop("any", subset=list(subset) if subset else None)


# ------------------------------------------------------------------ C1-C8

def _num(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def pearson(df: DataFrame, a: str, b: str, name: str = "r") -> DataFrame:
    """Pearson correlation of two columns (NaN treated as missing, pairwise)."""
    return df.agg(F.corr(_num(a), _num(b)).alias(name))


def _gram_rows(d: int, shift: list[float]):
    """Task function: one row (i, j, n, sx, sy, sxx, syy, sxy) per column pair, summed over the task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(d, 1)
        n, s, q, g = (np.zeros((d, d)) for _ in range(4))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns]) - np.array(shift)
            there = ~np.isnan(x)
            x[~there] = 0.0
            m = there.astype(np.float64)
            n += m.T @ m
            s += x.T @ m                 # s[i, j]: sum of column i over rows where column j is there
            q += (x * x).T @ m
            g += x.T @ x
        cols = [i, j, n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], g[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    return run


def corr_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation matrix in long form, one row per pair a_pos < b_pos.

    The same path at every width: each task sums masked products of its rows
    (a few d x d matrix products an Arrow batch), one row per task and pair
    moves, and a pair uses the rows in which both of its columns are there
    (null and NaN are missing).  Columns are shifted to near zero first, so
    the sums lose no digits.  A pair without two rows or without spread has a
    null coefficient.
    """
    cols = list(cols)
    d = len(cols)
    nums = df.select(*[_num(c).alias(f"c{i}") for i, c in enumerate(cols)])
    # Any number near a column's values will do as its shift: the mean of the rows at hand first.
    means = nums.limit(1000).agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(d)]).first() if d else []
    finite = [float(m) if m is not None and np.isfinite(m) else 0.0 for m in means]
    part = nums.mapInArrow(_gram_rows(d, finite), "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double")
    t = part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    r = F.when(F.col("n") >= 2, F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))))
    names = F.array(*[F.lit(c) for c in cols])
    return t.select(names[F.col("i").cast("int")].alias("a"), names[F.col("j").cast("int")].alias("b"),
                    F.col("i").cast("int").alias("a_pos"), F.col("j").cast("int").alias("b_pos"), r.alias("r"))


def top_abs_correlations(long: DataFrame, n: int = 50) -> DataFrame:
    """The n largest |r| of the upper triangle (ties by position)."""
    return (long.withColumn("abs_r", F.abs("r"))
                .orderBy(F.col("abs_r").desc(), F.col("a_pos"), F.col("b_pos")).limit(n))


def near_duplicates(long: DataFrame, threshold: float = 0.99999) -> DataFrame:
    """C4: right members of near-identical pairs that never appear as a left member."""
    top = long.filter(F.abs("r") > threshold)
    left = top.select(F.col("a").alias("feature")).distinct()
    right = top.select(F.col("b").alias("feature")).distinct()
    return right.join(left, "feature", "left_anti")


def _is_fit(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.contains(p)
    return out


def correlated_to_fit(long: DataFrame, threshold: float = 0.95,
                      fit_patterns: Sequence[str] = FIT_VARIABLE_PATTERNS) -> DataFrame:
    """Features with |r| > threshold against a fit variable (never the fit variables)."""
    a_fit, b_fit = _is_fit(F.col("a"), fit_patterns), _is_fit(F.col("b"), fit_patterns)
    hit = long.filter(F.abs("r") > threshold)
    x = hit.filter(a_fit & ~b_fit).select(F.col("b").alias("feature"))
    y = hit.filter(b_fit & ~a_fit).select(F.col("a").alias("feature"))
    return x.unionByName(y).distinct()


def correlated_features(long: DataFrame, threshold: float = 0.95,
                        fit_patterns: Sequence[str] = FIT_VARIABLE_PATTERNS,
                        prefer: str = KEEP_PREFERENCE) -> DataFrame:
    """One member of each strongly correlated pair of non-fit features.

    For pair (earlier a, later b) the earlier column is dropped unless its
    name contains ``prefer``, in which case the later one goes.
    """
    a_fit, b_fit = _is_fit(F.col("a"), fit_patterns), _is_fit(F.col("b"), fit_patterns)
    hit = long.filter((F.abs("r") > threshold) & ~a_fit & ~b_fit)
    return hit.select(F.when(F.col("a").contains(prefer), F.col("b")).otherwise(F.col("a")).alias("feature")) \
              .distinct()


def apply_drops(df: DataFrame, drops: DataFrame, mandatory: Sequence[str] = (), col: str = "feature") -> DataFrame:
    """Drop the listed features except names containing a mandatory one.

    The list is bounded by the schema width; it is the only thing collected.
    """
    names = [r[col] for r in drops.select(col).distinct().collect()]
    keep_m = list(mandatory)
    return df.drop(*[n for n in names if not any(m in n for m in keep_m)])


def score_pivot_correlation(df: DataFrame, score: str = "score", pivots: Sequence[str] = ("mbc", "deltae")) -> DataFrame:
    """Pearson of the guarded logit of the score with each pivot."""
    z = guarded_logit(score)
    return df.agg(*[F.corr(z, _num(p)).alias(f"corr_{p}") for p in pivots])
