"""Two-dimensional studies: hex counts, kernel densities and the fit-variable pair grid."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalar import logit
from ..operators import hist2d
from ..sources.fixtures import CAND_SQL, EVT_SQL, cand, evt, with_views
from .registry import register
from .sqlgen import hist_ctes

CAND = with_views(CAND_SQL)
EVT = with_views(EVT_SQL)
SQRT_2PI = math.sqrt(2.0 * math.pi)


def hex_sql(p: str, src: str, x: str, y: str, gridsize: int) -> str:
    nx = int(gridsize)
    ny = int(nx / math.sqrt(3))
    return f"""{p}_d AS (SELECT CAST({x} AS DOUBLE) AS _x, CAST({y} AS DOUBLE) AS _y FROM {src}
       WHERE ({x}) IS NOT NULL AND NOT isnan(CAST({x} AS DOUBLE)) AND ({y}) IS NOT NULL AND NOT isnan(CAST({y} AS DOUBLE))),
{p}_s AS (SELECT min(_x) AS x0, max(_x) AS x1, min(_y) AS y0, max(_y) AS y1 FROM {p}_d),
{p}_q AS (SELECT x0 - 1e-9 * (x1 - x0) AS xmin, ((x1 + 1e-9 * (x1 - x0)) - (x0 - 1e-9 * (x1 - x0))) / {nx}.0 AS sx,
                 y0 AS ymin, (y1 - y0) / {ny}.0 AS sy FROM {p}_s),
{p}_u AS (SELECT (_x - xmin) / sx AS u, (_y - ymin) / sy AS v, xmin, ymin, sx, sy FROM {p}_d, {p}_q),
{p}_w AS (SELECT *, round_even(u, 0) AS i1, round_even(v, 0) AS j1, floor(u) AS i2, floor(v) AS j2 FROM {p}_u),
{p}_z AS (SELECT *, (u - i1) * (u - i1) + 3.0 * (v - j1) * (v - j1) AS d1,
                 (u - i2 - 0.5) * (u - i2 - 0.5) + 3.0 * (v - j2 - 0.5) * (v - j2 - 0.5) AS d2 FROM {p}_w),
{p}_c AS (SELECT CASE WHEN d1 < d2 THEN 1 ELSE 2 END AS lattice,
                 CAST(CASE WHEN d1 < d2 THEN i1 ELSE i2 END AS INTEGER) AS i,
                 CAST(CASE WHEN d1 < d2 THEN j1 ELSE j2 END AS INTEGER) AS j, xmin, ymin, sx, sy FROM {p}_z),
{p}_out AS (SELECT lattice, i, j,
       round(xmin + (i + CASE WHEN lattice = 2 THEN 0.5 ELSE 0.0 END) * sx, 6) AS cx,
       round(ymin + (j + CASE WHEN lattice = 2 THEN 0.5 ELSE 0.0 END) * sy, 6) AS cy, COUNT(*) AS n
FROM {p}_c
WHERE (lattice = 1 AND i BETWEEN 0 AND {nx} AND j BETWEEN 0 AND {ny})
   OR (lattice = 2 AND i BETWEEN 0 AND {nx - 1} AND j BETWEEN 0 AND {ny - 1})
GROUP BY lattice, i, j, xmin, ymin, sx, sy)"""


def kde2_sql(p: str, src: str, x: str, y: str, grid: int = 32) -> str:
    return f"""{p}_d AS (SELECT CAST({x} AS DOUBLE) AS _x, CAST({y} AS DOUBLE) AS _y FROM {src}
       WHERE ({x}) IS NOT NULL AND NOT isnan(CAST({x} AS DOUBLE)) AND ({y}) IS NOT NULL AND NOT isnan(CAST({y} AS DOUBLE))),
{p}_s AS (SELECT COUNT(*) AS n, min(_x) AS Lx, max(_x) AS Hx, min(_y) AS Ly, max(_y) AS Hy,
                 stddev_samp(_x) * pow(COUNT(*), -1.0 / 6.0) AS bwx, stddev_samp(_y) * pow(COUNT(*), -1.0 / 6.0) AS bwy
          FROM {p}_d),
{p}_u AS (SELECT _x, _y, COUNT(*) AS c FROM {p}_d GROUP BY _x, _y),
{p}_g AS (SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j,
                 Lx + a.range * (Hx - Lx) / {grid - 1}.0 AS gx, Ly + b.range * (Hy - Ly) / {grid - 1}.0 AS gy, n, bwx, bwy
          FROM {p}_s, range({grid}) a, range({grid}) b),
{p}_out AS (SELECT i, j, round(gx, 6) AS x, round(gy, 6) AS y,
       round(SUM(c * exp(-0.5 * (((gx - _x) / bwx) * ((gx - _x) / bwx) + ((gy - _y) / bwy) * ((gy - _y) / bwy))))
             / (n * {2.0 * math.pi!r} * bwx * bwy), 12) AS density
FROM {p}_g, {p}_u GROUP BY i, j, gx, gy, n, bwx, bwy)"""


def _rounded(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


@register("h8_hex_counts", CAND.rstrip() + ",\nlc AS (SELECT mbc, ln(score / (1.0 - score)) AS logit_score FROM cand),\n"
          + hex_sql("hx", "lc", "mbc", "logit_score", 50) + "\nSELECT * FROM hx_out")
def h8_hex_counts(spark, sf):
    c = cand(spark, sf).withColumn("logit_score", logit("score"))
    return hist2d.hex_counts(c, "mbc", "logit_score", 50)


@register("h9_kde_1d", EVT + f""",
d AS (SELECT CAST(value AS DOUBLE) AS _x FROM evt WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT COUNT(*) AS n, min(_x) AS L, max(_x) AS H, stddev_samp(_x) * pow(COUNT(*), -0.2) AS bw FROM d),
u AS (SELECT _x, COUNT(*) AS c FROM d GROUP BY _x),
g AS (SELECT CAST(range AS INTEGER) AS k, L + range * (H - L) / 127.0 AS gx, n, bw FROM s, range(128))
SELECT k, round(gx, 6) AS x,
       round(SUM(c * exp(-0.5 * ((gx - _x) / bw) * ((gx - _x) / bw))) / (n * bw * {SQRT_2PI!r}), 12) AS density
FROM g, u GROUP BY k, gx, n, bw""")
def h9_kde_1d(spark, sf):
    return _rounded(hist2d.kde_1d(evt(spark, sf), "value", 128), x=6, density=12)


@register("h9_kde_2d", CAND.rstrip() + ",\n" + kde2_sql("k", "cand", "mbc", "deltae") + "\nSELECT * FROM k_out")
def h9_kde_2d(spark, sf):
    return _rounded(hist2d.kde_2d(cand(spark, sf), "mbc", "deltae", 32), x=6, y=6, density=12)


def kde_full_sql(places: int) -> str:
    return EVT.rstrip() + f""",
d AS (SELECT CAST(value AS DOUBLE) AS _x, CAST(score AS DOUBLE) AS _y FROM evt WHERE NOT isnan(value) AND NOT isnan(score)),
s AS (SELECT COUNT(*) AS n, min(_x) AS x0, max(_x) AS x1, min(_y) AS y0, max(_y) AS y1, var_samp(_x) AS vx, var_samp(_y) AS vy,
             covar_samp(_x, _y) AS c, pow(COUNT(*), -1.0::DOUBLE / 3.0) AS f FROM d),
k AS (SELECT *, vx * vy - c * c AS det FROM s),
g AS (SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j, x0 + a.range * (x1 - x0) / 23.0 AS gx, y0 + b.range * (y1 - y0) / 23.0 AS gy,
             n, vy / det / f AS pa, -c / det / f AS pb, vx / det / f AS pc, sqrt(det) * f AS width FROM k, range(24) a, range(24) b)
SELECT i, j, round(gx, 6) AS x, round(gy, 6) AS y,
       round(SUM(exp(-0.5 * (pa * (gx - _x) * (gx - _x) + 2 * pb * (gx - _x) * (gy - _y) + pc * (gy - _y) * (gy - _y)))) / (n * 2 * pi() * width), {places}) AS density
FROM g, d GROUP BY i, j, gx, gy, n, width"""


@register("h9_kde_2d_full", kde_full_sql(9))
def h9_kde_2d_full(spark, sf):
    """H9 with the full covariance of two strongly tied columns."""
    return _rounded(hist2d.kde_2d_full(evt(spark, sf), "value", "score", 24), x=6, y=6, density=9)


@register("h9_kde_2d_boxes", kde_full_sql(6))
def h9_kde_2d_boxes(spark, sf):
    """H9 with the full covariance by box sums, within 1e-10 of the kernel's peak."""
    return _rounded(hist2d.kde_2d_boxes(evt(spark, sf), "value", "score", 24, 1e-10), x=6, y=6, density=6)


_H10 = CAND.rstrip() + ",\n" + hist_ctes("ha", "cand", "mbc", 40) + ",\n" + hist_ctes("hb", "cand", "deltae", 40) \
    + ",\n" + hex_sql("hx", "cand", "mbc", "deltae", 60) + ",\n" + kde2_sql("kd", "cand", "mbc", "deltae") + """
SELECT 'hist' AS panel, 'mbc' AS x_var, 'mbc' AS y_var, bin AS i, 0 AS j,
       round(((L + bin * (H - L) / 40.0) + (L + (bin + 1) * (H - L) / 40.0)) / 2.0, 6) AS x, 0.0 AS y,
       CAST(n AS DOUBLE) AS value FROM ha_out
UNION ALL
SELECT 'hist', 'deltae', 'deltae', bin, 0,
       round(((L + bin * (H - L) / 40.0) + (L + (bin + 1) * (H - L) / 40.0)) / 2.0, 6), 0.0, CAST(n AS DOUBLE) FROM hb_out
UNION ALL
SELECT 'hex' || CAST(lattice AS VARCHAR), 'mbc', 'deltae', i, j, cx, cy, CAST(n AS DOUBLE) FROM hx_out
UNION ALL
SELECT 'kde', 'mbc', 'deltae', i, j, x, y, density FROM kd_out"""


@register("h10_pair_grid", _H10)
def h10_pair_grid(spark, sf):
    c = cand(spark, sf)
    return _rounded(hist2d.pair_grid(c, ["mbc", "deltae"], hist_bins=40, hex_gridsize=60, kde_grid=32), x=6, y=6, value=12)
