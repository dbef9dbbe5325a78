"""Two-dimensional summaries: hexagonal counts, kernel densities, pair grids.

Hex cells follow the usual two-lattice construction (as in matplotlib's
``hexbin``): one lattice at integer cell coordinates, a second offset by half
a cell; each point goes to the nearer centre (distance metric stretched by 3
along y).  It is a per-row column expression followed by a partial
aggregate, so it scales like a group-by.

Kernel densities sum the kernel of every row at every grid point, without
binning: a pass of matrix products over the rows that yields one small matrix
per task.  ``kde_2d_boxes`` sums rows into boxes first, within a stated error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hist import bin_index

SQRT_2PI = math.sqrt(2.0 * math.pi)


def _valid(c):
    return c.isNotNull() & ~F.isnan(c)


def hex_counts(df: DataFrame, x: str, y: str, gridsize: int = 50,
               extent: tuple[float, float, float, float] | None = None, places: int = 6) -> DataFrame:
    """H8: counts per hexagonal cell: (lattice, i, j, cx, cy, n)."""
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .filter(_valid(F.col("_x")) & _valid(F.col("_y")))
    nx = int(gridsize)
    ny = int(nx / math.sqrt(3))
    if extent is None:
        s = d.agg(F.struct(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"),
                           F.max("_y").alias("y1")).alias("s")).scalar()
        d = d.withColumn("_s", s)   # bound once: a single subquery in the plan
        x0, x1, y0, y1 = F.col("_s.x0"), F.col("_s.x1"), F.col("_s.y0"), F.col("_s.y1")
    else:
        x0, x1, y0, y1 = (F.lit(float(v)) for v in extent)
    # The nearer centre is chosen with ONE ``least`` over two structs
    # (distance first; on a tie the offset lattice wins, as in hexbin), so the
    # aggregation key is a single expression and codegen stays small.
    pad = F.lit(1e-9) * (x1 - x0)
    xmin = x0 - pad
    sx = ((x1 + pad) - xmin) / F.lit(float(nx))
    sy = (y1 - y0) / F.lit(float(ny))
    # ``inline`` of a one-element array is a projection boundary: u and v stay
    # attributes instead of being re-inlined into every use below (which
    # grew the generated code past the JIT limits).
    st = d.select(F.inline(F.array(F.struct(((F.col("_x") - xmin) / sx).alias("u"),
                                            ((F.col("_y") - y0) / sy).alias("v"),
                                            xmin.alias("_xmin"), y0.alias("_ymin"), sx.alias("_sx"),
                                            sy.alias("_sy")))))
    u, v = F.col("u"), F.col("v")
    keep = ["_xmin", "_ymin", "_sx", "_sy"]
    st = st.select(F.inline(F.array(F.struct(u, v, F.bround(u, 0).alias("i1"), F.bround(v, 0).alias("j1"),
                                             F.floor(u).cast("double").alias("i2"),
                                             F.floor(v).cast("double").alias("j2"), *keep))))
    i1, j1, i2, j2 = F.col("i1"), F.col("j1"), F.col("i2"), F.col("j2")
    d1 = (u - i1) * (u - i1) + F.lit(3.0) * (v - j1) * (v - j1)
    d2 = (u - i2 - 0.5) * (u - i2 - 0.5) + F.lit(3.0) * (v - j2 - 0.5) * (v - j2 - 0.5)
    on1 = d1 < d2
    cells = st.select(F.when(on1, 1).otherwise(2).alias("lattice"),
                      F.when(on1, i1).otherwise(i2).cast("int").alias("i"),
                      F.when(on1, j1).otherwise(j2).cast("int").alias("j"), *keep)
    g = cells.groupBy("lattice", "i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.first("_xmin").alias("_xmin"), F.first("_ymin").alias("_ymin"),
        F.first("_sx").alias("_sx"), F.first("_sy").alias("_sy"))
    inside = (((F.col("lattice") == 1) & F.col("i").between(0, nx) & F.col("j").between(0, ny)) |
              ((F.col("lattice") == 2) & F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1)))
    g = g.filter(inside)
    off = F.when(F.col("lattice") == 2, F.lit(0.5)).otherwise(F.lit(0.0))
    return g.select("lattice", "i", "j",
                    F.round(F.col("_xmin") + (F.col("i") + off) * F.col("_sx"), places).alias("cx"),
                    F.round(F.col("_ymin") + (F.col("j") + off) * F.col("_sy"), places).alias("cy"), "n")


def _axis(d: DataFrame, cols: list[str], power: float) -> tuple[int, list[tuple[float, float, float]]]:
    """(rows, per column: minimum, maximum, bandwidth std * n**power)."""
    r = d.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in cols
                                              for k, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_samp))]).first()
    n = r["n"]
    return n, [(r[f"lo_{c}"], r[f"hi_{c}"], (r[f"sd_{c}"] or 0.0) * n ** power) for c in cols] if n else []


def _kernel(points: np.ndarray, x: np.ndarray, h: float) -> np.ndarray:
    z = (points[None, :] - x[:, None]) / h
    return np.exp(-0.5 * z * z)


def _summed(d: DataFrame, grids: list[np.ndarray], hs: list[float]) -> DataFrame:
    """(at, total): the kernel sum at each grid point (first axis major) over all rows, exactly.

    Each task adds its rows' kernels - in two dimensions a matrix product of
    the two axes' kernels - so the work is linear in the rows and one small
    matrix a task moves.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros([len(g) for g in grids])
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            for i in range(0, len(b), 4096):
                k = [_kernel(g, c[i:i + 4096], h) for g, c, h in zip(grids, cols, hs)]
                total += k[0].sum(axis=0) if len(k) == 1 else k[0].T @ k[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "total"])

    return d.mapInArrow(run, "at long, total double").groupBy("at").agg(F.sum("total").alias("total"))


def kde_1d(df: DataFrame, x: str, grid: int = 128, bw: float | None = None) -> DataFrame:
    """H9 (1-D): Gaussian KDE on ``grid`` points over [min, max], Scott bandwidth n^(-1/5) * std; no binning.

    The density is null where the bandwidth is zero; an empty table has no rows.
    """
    d = df.select(F.col(x).cast("double").alias("_x")).filter(_valid(F.col("_x")))
    n, axes = _axis(d, ["_x"], -0.2)
    if not n:
        return df.sparkSession.createDataFrame([], "k int, x double, density double")
    (lo, hi, h), = axes
    h = float(bw) if bw else h
    g = lo + np.arange(grid) * (hi - lo) / (grid - 1)
    at = F.array(*[F.lit(float(v)) for v in g])
    return _summed(d, [g], [h or 1.0]).select(F.col("at").cast("int").alias("k"), at[F.col("at").cast("int")].alias("x"),
                                              F.when(F.lit(h > 0), F.col("total") / F.lit(n * (h or 1.0) * SQRT_2PI)).alias("density"))


def kde_2d(df: DataFrame, x: str, y: str, grid: int = 32) -> DataFrame:
    """H9 (2-D): product-Gaussian KDE on a grid x grid lattice, Scott factor n^(-1/6) per axis; no binning."""
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .filter(_valid(F.col("_x")) & _valid(F.col("_y")))
    n, axes = _axis(d, ["_x", "_y"], -1.0 / 6.0)
    if not n:
        return df.sparkSession.createDataFrame([], "i int, j int, x double, y double, density double")
    gs = [lo + np.arange(grid) * (hi - lo) / (grid - 1) for lo, hi, _ in axes]
    hx, hy = (h for _, _, h in axes)
    i, j = (F.col("at") / grid).cast("int"), (F.col("at") % grid).cast("int")
    ax, ay = (F.array(*[F.lit(float(v)) for v in g]) for g in gs)
    dens = F.when(F.lit(hx > 0 and hy > 0), F.col("total") / F.lit(n * 2.0 * math.pi * (hx or 1.0) * (hy or 1.0)))
    return _summed(d, gs, [hx or 1.0, hy or 1.0]).select(i.alias("i"), j.alias("j"), ax[i].alias("x"), ay[j].alias("y"), dens.alias("density"))


def kde_2d_full(df: DataFrame, x: str, y: str, grid: int = 32) -> DataFrame:
    """H9 (2-D, full covariance): Gaussian KDE whose kernel has the rows' covariance, Scott factor n^(-1/6); no binning.

    The kernel is split into one of x alone and one of y given x, so that a
    task adds, column of the lattice by column, the y kernels of its rows
    weighted by their x kernels; rows whose x kernel is exactly 0 there are
    left out of the column.  The density is null where the covariance is singular.
    """
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .filter(_valid(F.col("_x")) & _valid(F.col("_y")))
    r = d.agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"),
              F.var_samp("_x").alias("vx"), F.var_samp("_y").alias("vy"), F.covar_samp("_x", "_y").alias("c")).first()
    n = r["n"]
    if not n:
        return df.sparkSession.createDataFrame([], "i int, j int, x double, y double, density double")
    factor = n ** (-1.0 / 3.0)
    vx, vy, c = ((r[k] or 0.0) * factor for k in ("vx", "vy", "c"))
    det = vx * vy - c * c
    fits = bool(vx > 0 and det > 1e-12 * vx * vy)
    slope, narrow = (c / vx, det / vx) if fits else (0.0, 1.0)
    gx, gy = (a + np.arange(grid) * (b - a) / (grid - 1) for a, b in ((r["x0"], r["x1"]), (r["y0"], r["y1"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((grid, grid))
        for b in batches:
            cols = [k.to_numpy(zero_copy_only=False) for k in b.columns]
            for i in range(0, len(b), 4096):
                xs, ys = (k[i:i + 4096] for k in cols)
                for j, g in enumerate(gx):
                    w = np.exp(-0.5 * (g - xs) ** 2 / (vx if fits else 1.0))
                    near = w > 0
                    if near.any():
                        mid = ys[near] + slope * (g - xs[near])
                        total[j] += w[near] @ _kernel(gy, mid, math.sqrt(narrow))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "total"])

    sums = d.mapInArrow(run, "at long, total double").groupBy("at").agg(F.sum("total").alias("total"))
    i, j = (F.col("at") / grid).cast("int"), (F.col("at") % grid).cast("int")
    ax, ay = (F.array(*[F.lit(float(v)) for v in g]) for g in (gx, gy))
    dens = F.when(F.lit(fits), F.col("total") / F.lit(n * 2.0 * math.pi * math.sqrt(det) if fits else 1.0))
    return sums.select(i.alias("i"), j.alias("j"), ax[i].alias("x"), ay[j].alias("y"), dens.alias("density"))


def expansion_terms(error: float) -> int:
    """Terms an axis that keep a row's kernel within ``error`` of its peak, for boxes one bandwidth wide.

    Hermite functions obey |He_a(t)| exp(-t^2 / 2) <= 1.0865 sqrt(a!), so the
    terms from p on add at most e = 1.0865 sum 0.5^a / sqrt(a!), and the
    product of two axes is off by at most (2 + e) e.
    """
    if not error > 1e-14:
        raise ValueError("error must be above 1e-14")
    for p in range(1, 40):
        e = 1.0865 * sum(0.5 ** a / math.sqrt(math.factorial(a)) for a in range(p, p + 40))
        if (2 + e) * e <= error:
            return p
    raise AssertionError


def _hermite(t: np.ndarray, terms: int) -> Iterator[np.ndarray]:
    """He_a(t) exp(-t^2 / 2) / a! for a = 0, 1, ..."""
    before, now = np.zeros_like(t), np.exp(-0.5 * t * t)
    for a in range(terms):
        yield now
        before, now = now, (t * now - before) / (a + 1)


def kde_2d_boxes(df: DataFrame, x: str, y: str, grid: int = 32, error: float = 1e-8, open_boxes: int = 4096) -> DataFrame:
    """H9 (2-D, full covariance) by box sums: ``kde_2d_full`` within ``error`` times the kernel's peak.

    The rows, whitened by the kernel's covariance, are summed into boxes one
    bandwidth wide: a box keeps the sums of the products of its rows' powers
    of their distance to its centre, which tasks add up and a shuffle merges.  Every
    box then meets the lattice once, by its Hermite series
    (``expansion_terms``).  Rows cost the same whatever the lattice, and the
    boxes grow with the cube root of the rows.  A task holds ``open_boxes``
    boxes and passes them on when they are full.  Null and NaN rows are left
    out; the density is null where the covariance is singular; an empty table has no rows.
    """
    terms = expansion_terms(error)
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .filter(_valid(F.col("_x")) & _valid(F.col("_y")))
    r = d.agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"),
              F.avg("_x").alias("mx"), F.avg("_y").alias("my"),
              F.var_samp("_x").alias("vx"), F.var_samp("_y").alias("vy"), F.covar_samp("_x", "_y").alias("c")).first()
    n = r["n"]
    if not n:
        return df.sparkSession.createDataFrame([], "i int, j int, x double, y double, density double")
    mx, my = r["mx"], r["my"]
    factor = n ** (-1.0 / 3.0)
    vx, vy, c = ((r[k] or 0.0) * factor for k in ("vx", "vy", "c"))
    det = vx * vy - c * c
    fits = bool(vx > 0 and det > 1e-12 * vx * vy)
    slope, sx, sy = (c / vx, math.sqrt(vx), math.sqrt(det / vx)) if fits else (0.0, 1.0, 1.0)
    gx, gy = (a + np.arange(grid) * (b - a) / (grid - 1) for a, b in ((r["x0"], r["x1"]), (r["y0"], r["y1"])))
    names = [f"m{k}" for k in range(terms * terms)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys, m = np.array(list(held), dtype=np.int64).reshape(-1, 2), np.array(list(held.values())).reshape(-1, terms * terms)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), *[pa.array(v) for v in m.T]], ["bx", "by", *names])

        for b in batches:
            for i in range(0, len(b), 4096):
                xs, ys = (k.to_numpy(zero_copy_only=False)[i:i + 4096] for k in b.columns)
                z = np.stack([(xs - mx) / sx, (ys - my - slope * (xs - mx)) / sy], axis=1)
                box = np.floor(z)
                order = np.lexsort((box[:, 1], box[:, 0]))
                z, box = z[order] - box[order] - 0.5, box[order].astype(np.int64)
                first = np.flatnonzero(np.r_[True, (box[1:] != box[:-1]).any(axis=1)])
                u, v = (np.vander(z[:, k], terms, increasing=True) for k in (0, 1))
                m = np.add.reduceat((u[:, :, None] * v[:, None, :]).reshape(len(z), -1), first, axis=0)
                for key, row in zip(map(tuple, box[first].tolist()), m):
                    held[key] = held[key] + row if key in held else row
                if len(held) > open_boxes:
                    yield out()
        yield out()

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((grid, grid))
        zx = (gx - mx) / sx
        zy = (gy[None, :] - my - slope * (gx[:, None] - mx)) / sy
        step = max(1, 2 ** 19 // grid ** 2)
        for b in batches:
            cols = [k.to_numpy(zero_copy_only=False) for k in b.columns]
            for i in range(0, len(b), step):
                cx, cy, *m = (k[i:i + step] for k in cols)
                m = np.stack(m, axis=1).reshape(-1, terms, terms)
                along = np.stack(list(_hermite(zx[None, :] - cx[:, None] - 0.5, terms)), axis=2) @ m
                for k, h in enumerate(_hermite(zy[None] - cy[:, None, None] - 0.5, terms)):
                    total += np.einsum("bj,bji->ji", along[:, :, k], h)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "total"])

    boxes = d.mapInArrow(sums, "bx long, by long, " + ", ".join(f"{m} double" for m in names)) \
             .groupBy("bx", "by").agg(*[F.sum(m).alias(m) for m in names])
    sums_at = boxes.mapInArrow(lattice, "at long, total double").groupBy("at").agg(F.sum("total").alias("total"))
    i, j = (F.col("at") / grid).cast("int"), (F.col("at") % grid).cast("int")
    ax, ay = (F.array(*[F.lit(float(v)) for v in g]) for g in (gx, gy))
    dens = F.when(F.lit(fits), F.col("total") / F.lit(n * 2.0 * math.pi * math.sqrt(det) if fits else 1.0))
    return sums_at.select(i.alias("i"), j.alias("j"), ax[i].alias("x"), ay[j].alias("y"), dens.alias("density"))


def pair_grid(df: DataFrame, cols: list[str], hist_bins: int = 40, hex_gridsize: int = 60,
              kde_grid: int = 32) -> DataFrame:
    """Diagonal histograms, lower-triangle KDEs, upper-triangle hex counts, one long table.

    Columns: panel, x_var, y_var, i, j, x, y, value.
    """
    from .hist import histogram
    parts = []
    for a in cols:
        h = histogram(df, a, hist_bins)
        parts.append(h.select(F.lit("hist").alias("panel"), F.lit(a).alias("x_var"), F.lit(a).alias("y_var"),
                              F.col("bin").alias("i"), F.lit(0).alias("j"), F.col("center").alias("x"),
                              F.lit(0.0).alias("y"), F.col("n").cast("double").alias("value")))
    for ia, a in enumerate(cols):
        for ib, b in enumerate(cols):
            if ia < ib:
                hx = hex_counts(df, a, b, hex_gridsize)
                parts.append(hx.select(F.concat(F.lit("hex"), F.col("lattice").cast("string")).alias("panel"),
                                       F.lit(a).alias("x_var"), F.lit(b).alias("y_var"), "i", "j",
                                       F.col("cx").alias("x"), F.col("cy").alias("y"),
                                       F.col("n").cast("double").alias("value")))
            elif ia > ib:
                k = kde_2d(df, b, a, kde_grid)
                parts.append(k.select(F.lit("kde").alias("panel"), F.lit(b).alias("x_var"), F.lit(a).alias("y_var"),
                                      "i", "j", "x", "y", F.col("density").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
