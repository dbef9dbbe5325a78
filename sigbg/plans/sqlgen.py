"""DuckDB oracle text for the repeated shapes (histogram, tail truncation).

These only produce the *oracle* SQL used by the correctness gate; the
Spark side is the DataFrame code in ``sigbg.operators``.
"""

from __future__ import annotations

from collections.abc import Sequence


def _sel(by: Sequence[str]) -> str:
    return "".join(f"{b}, " for b in by)


def trunc_cte(name: str, src: str, x: str, nsigma: float, by: Sequence[str] = ()) -> str:
    """CTEs ``{name}`` = rows of ``src`` surviving the two-pass n-sigma cut."""
    ns = float(nsigma)
    if by:
        on = " AND ".join(f"s.{b} = t.{b}" for b in by)
        g = ", ".join(by)
        return f"""{name}_s0 AS (SELECT {g}, avg({x}) AS m, stddev_pop({x}) AS s FROM {src} GROUP BY {g}),
{name}_t1 AS (SELECT t.* FROM {src} t JOIN {name}_s0 s ON {on} WHERE t.{x} > s.m - {ns} * s.s),
{name}_s1 AS (SELECT {g}, avg({x}) AS m, stddev_pop({x}) AS s FROM {name}_t1 GROUP BY {g}),
{name} AS (SELECT t.* FROM {name}_t1 t JOIN {name}_s1 s ON {on} WHERE t.{x} < s.m + {ns} * s.s)"""
    return f"""{name}_s0 AS (SELECT avg({x}) AS m, stddev_pop({x}) AS s FROM {src}),
{name}_t1 AS (SELECT t.* FROM {src} t, {name}_s0 s WHERE t.{x} > s.m - {ns} * s.s),
{name}_s1 AS (SELECT avg({x}) AS m, stddev_pop({x}) AS s FROM {name}_t1),
{name} AS (SELECT t.* FROM {name}_t1 t, {name}_s1 s WHERE t.{x} < s.m + {ns} * s.s)"""


def hist_ctes(p: str, src: str, x: str, nbins: int, by: Sequence[str] = (), shared: bool = True,
              where: str | None = None) -> str:
    """CTEs ending in ``{p}_out(by..., bin, L, H, n)`` matching ``operators.hist.histogram``."""
    by = list(by)
    bs = _sel(by)
    n = int(nbins)
    cond = f"({x}) IS NOT NULL AND NOT isnan(CAST({x} AS DOUBLE))" + (f" AND ({where})" if where else "")
    per_group = bool(by) and not shared
    st_group = f"{bs}" if per_group else ""
    st_grp_by = f"GROUP BY {', '.join(by)}" if per_group else ""
    if per_group:
        join_st = "JOIN " + f"{p}_st USING ({', '.join(by)})"
        hg = f"SELECT {bs}L, H FROM {p}_st"
    else:
        join_st = f"CROSS JOIN {p}_st"
        hg = (f"SELECT g.*, L, H FROM (SELECT DISTINCT {', '.join(by)} FROM {p}_src) g CROSS JOIN {p}_st"
              if by else f"SELECT L, H FROM {p}_st")
    cmatch = " AND ".join([f"g.{b} = c.{b}" for b in by] + ["g.bin = c.bin"])
    return f"""{p}_src AS (SELECT {bs}CAST({x} AS DOUBLE) AS _x FROM {src} WHERE {cond}),
{p}_st0 AS (SELECT {st_group}min(_x) AS L0, max(_x) AS H0 FROM {p}_src {st_grp_by}),
{p}_st AS (SELECT *, CASE WHEN H0 = L0 THEN L0 - 0.5 ELSE L0 END AS L,
                      CASE WHEN H0 = L0 THEN H0 + 0.5 ELSE H0 END AS H FROM {p}_st0 WHERE L0 IS NOT NULL),
{p}_b AS (SELECT {bs}LEAST(CAST(floor((_x - L) * ({n}.0 / (H - L))) AS INTEGER), {n - 1}) AS bin
          FROM {p}_src {join_st}),
{p}_c AS (SELECT {bs}bin, COUNT(*) AS _n FROM {p}_b GROUP BY ALL),
{p}_g AS ({hg}),
{p}_grid AS (SELECT g.*, CAST(r.range AS INTEGER) AS bin FROM {p}_g g CROSS JOIN range({n}) r),
{p}_out AS (SELECT g.*, CAST(COALESCE(c._n, 0) AS BIGINT) AS n FROM {p}_grid g LEFT JOIN {p}_c c ON {cmatch})"""


def hist_select(p: str, nbins: int, by: Sequence[str] = (), places: int = 6) -> str:
    by = list(by)
    bs = _sel(by)
    n = int(nbins)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    lo = f"L + bin * (H - L) / {n}.0"
    hi = f"L + (bin + 1) * (H - L) / {n}.0"
    return f"""SELECT {bs}bin, round({lo}, {places}) AS lo_edge, round({hi}, {places}) AS hi_edge,
       round((({lo}) + ({hi})) / 2.0, {places}) AS center, n,
       round(n / SUM(n) OVER ({part}), 9) AS frac,
       round(n / (SUM(n) OVER ({part}) * ((H - L) / {n}.0)), {places}) AS density
FROM {p}_out"""


def hist_sql(views: str, src: str, x: str, nbins: int, by: Sequence[str] = (), shared: bool = True,
             where: str | None = None, extra_ctes: str | None = None) -> str:
    """Full oracle query for ``operators.hist.histogram``."""
    head = views.rstrip()
    if extra_ctes:
        head += ",\n" + extra_ctes
    return head + ",\n" + hist_ctes("h", src, x, nbins, by, shared, where) + "\n" + hist_select("h", nbins, by)
