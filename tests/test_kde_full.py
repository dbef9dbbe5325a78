"""Full-covariance kernel density against the direct sum."""

import numpy as np
import pytest

from sigbg.operators import hist2d


def test_equals_the_direct_sum(spark):
    r = np.random.default_rng(8)
    xy = r.multivariate_normal([1.0, -20.0], [[2.0, 5.1], [5.1, 14.0]], 700)
    rows = [(float(a), float(b)) for a, b in xy] + [(None, 1.0), (float("nan"), 1.0)]
    got = hist2d.kde_2d_full(spark.createDataFrame(rows, "x double, y double").repartition(4), "x", "y", 9).collect()
    cov = np.cov(xy.T) * len(xy) ** (-1 / 3)
    p, width = np.linalg.inv(cov), 2 * np.pi * np.sqrt(np.linalg.det(cov))
    assert len(got) == 81
    for g in got:
        d = np.array([g.x, g.y]) - xy
        want = np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, p, d)).sum() / (len(xy) * width)
        assert g.density == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_singular_and_empty(spark):
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "x double, y double")
    assert all(r.density is None for r in hist2d.kde_2d_full(line, "x", "y", 4).collect())
    assert hist2d.kde_2d_full(line.limit(0), "x", "y", 4).count() == 0


@pytest.mark.parametrize("error", [1e-3, 1e-6, 1e-10])
def test_box_sums_keep_their_bound(spark, error):
    r = np.random.default_rng(9)
    xy = np.r_[r.multivariate_normal([1.0, -20.0], [[2.0, 5.1], [5.1, 14.0]], 900), r.normal(6.0, 0.3, (300, 2))]
    rows = [(float(a), float(b)) for a, b in xy] + [(None, 1.0), (1.0, float("nan"))] + [(1.5, -18.0)] * 200
    xy = np.array([v for v in rows if v[0] is not None and v[1] == v[1]])
    df = spark.createDataFrame(rows, "x double, y double").repartition(5)
    cov = np.cov(xy.T) * len(xy) ** (-1 / 3)
    p, peak = np.linalg.inv(cov), 1 / (2 * np.pi * np.sqrt(np.linalg.det(cov)))
    got = hist2d.kde_2d_boxes(df, "x", "y", 7, error, open_boxes=20).collect()
    assert len(got) == 49
    off = []
    for g in got:
        d = np.array([g.x, g.y]) - xy
        off.append(abs(g.density - np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, p, d)).sum() / len(xy) * peak))
    assert max(off) <= error * peak


def test_box_sums_of_odd_tables(spark):
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "x double, y double")
    assert all(r.density is None for r in hist2d.kde_2d_boxes(line, "x", "y", 4).collect())
    assert hist2d.kde_2d_boxes(line.limit(0), "x", "y", 4).count() == 0
    with pytest.raises(ValueError):
        hist2d.kde_2d_boxes(line, "x", "y", 4, error=0.0)
    assert hist2d.expansion_terms(1e-3) < hist2d.expansion_terms(1e-9) < 20
