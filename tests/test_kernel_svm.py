"""Random Fourier features and the machines on them."""

import numpy as np
import pytest

from sigbg.operators import kernel_svm as ks


def test_kernel_error_falls_with_features():
    x = np.random.default_rng(2).normal(size=(60, 8))
    for gamma in (1e-3, 0.05, 0.3):
        exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
        err = []
        for n in (64, 1024, 8192):
            z = ks.FourierMap.draw(8, n)(x, gamma)[:, :-1]
            err.append(np.abs(z @ z.T - exact).max())
        assert err[2] < err[0] and err[2] < 5 / np.sqrt(8192)
    assert (ks.FourierMap.draw(3, 5).w == ks.FourierMap.draw(3, 5).w).all()


def test_newton_finds_the_minimum(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 2))
    y = ((x ** 2).sum(axis=1) > 1.4).astype(int)                    # a ring: no line separates it
    df = spark.createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, y))], "k long, features array<double>, labels int").repartition(3)
    rows, fourier = ks.Rows(df, "features", "labels"), ks.FourierMap.draw(2, 64)
    machines = [ks.Machine(0.5, c, 0, np.zeros(65)) for c in (0.1, 10.0)]
    ks.fit(rows, fourier, machines)
    z, s = fourier(x, 0.5), 2.0 * y - 1
    for m in machines:
        assert m.done
        gap = np.maximum(0, 1 - s * (z @ m.weights))
        hold = np.ones(65)
        hold[-1] = 1e-8
        grad = hold * m.weights - 2 * m.c * z.T @ (s * gap)
        assert np.abs(grad).max() < 1e-3 * m.c + 1e-4
        assert ((z @ m.weights > 0) == y).mean() > 0.9
    got = ks.decisions(rows, fourier, machines).toPandas()
    assert sorted(got[got.machine == 1].score.round(6)) == pytest.approx(sorted((z @ machines[1].weights).round(6)))


def test_a_task_sends_one_sum_a_machine(spark):
    r = np.random.default_rng(4)
    x, y = r.normal(size=(120, 2)), np.arange(120) % 2
    df = spark.createDataFrame([([float(a) for a in v], int(c)) for v, c in zip(x, y)], "features array<double>, labels int").repartition(2)
    rows, fourier = ks.Rows(df, "features", "labels"), ks.FourierMap.draw(2, 8)
    machines = [ks.Machine(0.5, c, 0, np.zeros(9)) for c in (0.1, 10.0)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")       # many blocks a task
    try:
        run, end = ks._parts(fourier, machines)
        got = rows.passes(run, "machine int, sums binary", end).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) <= len(machines) * rows.table.rdd.getNumPartitions()
    z = fourier(x, 0.5)
    want = np.concatenate([(z.T @ z)[np.triu_indices(9)], z.T @ (2.0 * y - 1)])
    for i in range(2):
        assert np.allclose(sum(np.frombuffer(bytes(g.sums), np.float64) for g in got if g.machine == i), want)
