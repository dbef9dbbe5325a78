"""Histogram boosting against a plain version written row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigbg.operators import boosting as bo


def table(spark, n=160, parts=3, missing=True):
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(n, 4)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + 0.3 * r.normal(size=n) > 0).astype(int)
    rows = [(i, [float("nan") if missing and (i + j) % 17 == 0 else float(v) for j, v in enumerate(x[i])], int(y[i]), 1.0 + i % 3, i % 4)
            for i in range(n)]
    return spark.createDataFrame(rows, "k long, features array<double>, labels int, wt double, fold int").repartition(parts), rows


def plain_tree(x, y, w, margin, edges, features, p, use):
    """One tree by trying every feature, cut and side for missing values on lists of rows."""
    prob = [1 / (1 + math.exp(-m)) for m in margin]
    g, h = [wi * (pi - yi) for wi, pi, yi in zip(w, prob, y)], [wi * pi * (1 - pi) for wi, pi in zip(w, prob)]
    lam = p["lambda"]
    out = {}

    def leaf(rows):
        return -p["eta"] * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + lam)

    def grow(node, rows, depth):
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = None
        for f in features if depth < p["max_depth"] else ():
            for side in (False, True):
                if side and not any(math.isnan(x[i][f]) for i in rows):
                    continue
                for e in edges[f]:
                    left = [i for i in rows if (side if math.isnan(x[i][f]) else x[i][f] < e)]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    gr, hr = G - gl, H - hl
                    if not left or len(left) == len(rows) or hl < p["min_child_weight"] or hr < p["min_child_weight"]:
                        continue
                    gain = gl * gl / (hl + lam) + gr * gr / (hr + lam) - G * G / (H + lam)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, e, side, left)
        if best is None or best[0] <= max(1e-6, p["gamma"]):
            out[node] = (None, None, leaf(rows))
            return
        gain, f, e, side, left = best
        out[node] = (gain, f, float(e))
        grow(2 * node + 1, left, depth + 1)
        grow(2 * node + 2, [i for i in rows if i not in set(left)], depth + 1)

    grow(0, use, 0)
    return out


@pytest.mark.parametrize("params", [
    {"eta": 0.3, "max_depth": 3}, {"eta": 0.1, "max_depth": 4, "gamma": 0.7, "min_child_weight": 2.5, "subsample": 0.7, "colsample_bytree": 0.6}])
def test_trees_equal_a_plain_version(spark, params):
    df, rows = table(spark)
    data = bo.Data(df, "k", weight="wt", fold="fold", max_bins=12)
    model, _ = bo.train(data, params, 4, hold=3, seed=7, patience=None)
    p = model.params
    uid = np.array([r.u for r in df.select("k", F.xxhash64("k").alias("u")).orderBy("k").collect()])
    x, y, w = [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]
    bins = bo.to_bins(np.array(x), model.edges)
    got = {}
    for r in bo.tree_table(spark, model).collect():
        got.setdefault(r.tree, {})[r.node] = (r.gain, r.feature, r.value if r.feature is None else r.threshold)
    for t in range(4):
        margin = model.margins(bins, 0, t)
        used = bo.chosen(uid, 7, t, p["subsample"])
        use = [i for i, r in enumerate(rows) if r[4] != 3 and used[i]]
        want = plain_tree(x, y, w, margin, model.edges, list(model.features(t)), p, use)
        assert set(want) == set(got[t])
        for n, (gain, f, v) in want.items():
            assert got[t][n][1] == f and got[t][n][2] == pytest.approx(v, abs=1e-9) and (gain is None or got[t][n][0] == pytest.approx(gain, abs=1e-7))


def test_partitions_resume_and_patience(spark, monkeypatch):
    params = {"eta": 0.2, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8}
    df, rows = table(spark)
    data = bo.Data(df, "k", fold="fold", max_bins=16)
    whole, curve = bo.train(data, params, 20, hold=1, patience=None)
    monkeypatch.setattr(bo, "STORE_ROUNDS", 3)
    part, _ = bo.train(data, params, 7, hold=1, patience=None)
    part, _ = bo.train(data, params, 20, hold=1, patience=None, model=part)      # resumed: the same model
    one = bo.Data(df.coalesce(1), "k", fold="fold", max_bins=16)
    alone, _ = bo.train(one, params, 20, hold=1, patience=None)
    x = bo.to_bins(np.array([r[1] for r in rows]), whole.edges)
    assert np.allclose(whole.margins(x), part.margins(x)) and np.allclose(whole.margins(x), alone.margins(x))
    held = np.array([r[4] == 1 for r in rows])
    y = np.array([r[2] for r in rows])[held]
    for r in curve:                                                       # every round's AUC and error by brute force
        s = bo.sigmoid(whole.margins(x, 0, r["round"] + 1))[held]
        pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
        assert r["auc"] == pytest.approx(np.mean(pairs)) and r["error"] == pytest.approx(np.mean((s > 0.5) != y))
    assert len(curve) == 20 and whole.best_iteration == max(curve, key=lambda r: (r["auc"], -r["round"]))["round"]
    monkeypatch.setattr(bo, "EVAL_ROUNDS", 5)
    early, short = bo.train(data, params, 20, hold=1, patience=4)
    best = next(b for b in range(20) if all(curve[i]["auc"] <= curve[b]["auc"] for i in range(b + 1, min(20, b + 5)))
                and all(curve[i]["auc"] < curve[b]["auc"] for i in range(b)))
    assert early.best_iteration == best and len(early.trees) == min(20, best + 5) == len(short)
    scored = bo.score(early, df).select("k", "score").collect()
    assert {r.k: round(r.score, 9) for r in scored} == {i: round(float(v), 9) for i, v in enumerate(bo.sigmoid(early.margins(x, 0, best + 1)))}


@pytest.mark.parametrize("kind", ["tree", "forest"])
def test_dropout(spark, kind):
    df, rows = table(spark)
    data = bo.Data(df, "k", max_bins=16)
    params = {"booster": "dart", "eta": 0.3, "max_depth": 2, "rate_drop": 0.5, "skip_drop": 0.1, "normalize_type": kind, "sample_type": "weighted"}
    m, _ = bo.train(data, params, 12, patience=None)
    weights, b = [], bo.Booster(params, data.edges, 42)
    for t in range(12):                                                   # weights follow the draws of the rounds
        b.weights, b.trees = list(weights), m.trees[:t]
        drop, k = b.dropped(t), len(b.dropped(t))
        for i in drop:
            weights[i] *= k / (k + 0.3) if kind == "tree" else 1 / 1.3
        weights.append(1.0 if not k else 1 / (k + 0.3) if kind == "tree" else 1 / 1.3)
    assert m.weights == pytest.approx(weights) and min(weights) < 1
    x = bo.to_bins(np.array([r[1] for r in rows]), m.edges)
    y = np.array([r[2] for r in rows])
    b.weights, b.trees = m.weights[:11], m.trees[:11]
    assert np.mean((bo.sigmoid(m.margins(x)) > 0.5) == y) > 0.8
    a, _ = bo.train(data, params, 5, patience=None)
    a, _ = bo.train(data, params, 12, patience=None, model=a)
    assert np.allclose(a.margins(x), m.margins(x)) and np.allclose(a.weights, m.weights)


def test_hyperband_resumes_survivors(spark):
    df, _ = table(spark)
    data = bo.Data(df, "k", fold="fold", max_bins=16)
    draws = {s: [{"eta": 0.05 + 0.02 * i, "max_depth": 2 + i % 3} for i in range(n)] for s, n in ((2, 9), (1, 5), (0, 3))}
    got = bo.hyperband(data, lambda s, n: draws[s][:n], hold=1, max_iter=9)
    assert {(s, r): sum(1 for x in got if x[:2] == (s, r)) for s in (2, 1, 0) for r in range(s + 1)} == \
        {(2, 0): 9, (2, 1): 3, (2, 2): 1, (1, 0): 5, (1, 1): 1, (0, 0): 3}
    last = max((x for x in got if x[:2] == (2, 2)), key=lambda x: x[4])
    again, curve = bo.train(data, draws[2][last[2]], 9, hold=1, patience=None)
    assert last[3] == 9.0 and curve[8]["auc"] == pytest.approx(last[4])


def test_empty_and_one_class(spark):
    schema = "k long, features array<double>, labels int"
    one = bo.Data(spark.createDataFrame([(i, [float(i), None], 1) for i in range(5)], schema), "k")
    m, _ = bo.train(one, {"max_depth": 2}, 2, patience=None)
    assert len(m.trees) == 2 and m.margins(bo.to_bins(np.array([[1.0, np.nan]]), m.edges))[0] > 0
    none = bo.Data(spark.createDataFrame([], schema), "k")
    m, _ = bo.train(none, {"max_depth": 2}, 1, patience=None)
    assert len(m.trees) == 1


def _stages(spark, data, models, rounds):
    """Stages of the jobs of a training, by job."""
    spark.sparkContext.setJobGroup("boost-test", "")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("boost-test"))
    data.grow(models, [rounds] * len(models))
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup("boost-test")) - before
    return [len(spark.sparkContext.statusTracker().getJobInfo(j).stageIds) for j in jobs]


def test_histograms_move_by_row_groups_not_by_tasks(spark, monkeypatch):
    df, rows = table(spark, n=300, parts=4)
    params = [{"eta": 0.3, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8}, {"eta": 0.2, "max_depth": 2},
              {"booster": "dart", "eta": 0.3, "max_depth": 2, "rate_drop": 0.5}]
    data = bo.Data(df, "k", fold="fold", max_bins=16)
    assert data.rdd.getNumPartitions() > 1
    x = bo.to_bins(np.array([r[1] for r in rows]), data.edges)
    new = lambda: [bo.Booster(p, data.edges, 42, 1) for p in params]
    together = new()
    assert set(_stages(spark, data, together, 3)) == {1}                  # one group of rows: no shuffle, however many tasks
    monkeypatch.setattr(bo, "LEAST_BYTES", 1)
    monkeypatch.setattr(bo, "GROUP_BYTES", 1)
    monkeypatch.setattr(bo, "MODELS", 2)
    monkeypatch.setattr(bo, "STORE_ROUNDS", 2)
    apart = new()
    assert set(_stages(spark, data, apart, 3)) == {2}                     # a group a partition, two slices of models
    for a, b in zip(together, apart):
        assert len(b.trees) == 3 and np.allclose(a.margins(x), b.margins(x)) and np.allclose(a.weights, b.weights)
