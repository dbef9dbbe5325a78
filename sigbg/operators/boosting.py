"""Second-order histogram boosting on Spark: logistic loss, tree dropout, staged evaluation, resumable.

Features are cut once at quantiles into at most MAX_BINS bins; the binned rows
are stored as packed blocks.  A pass over them adds up, for every open node of
every model in training, gradients and hessians by feature and bin, and only the
best split of each node comes to the driver.  Many models - folds, draws, rungs
of a search - grow in the same passes.  A model is its list of trees: what a
row's margin is follows from it, so a lost executor recomputes its rows from the
stored blocks, and training resumes where a list ends.

A deep level's histograms are larger than the bins of its rows, so rows are kept
together in groups of blocks, and the (model, features) of a pass are dealt over
copies of every group until all cores have work.  Only groups are added by
shuffle: its bytes grow with the number of groups - LEAST_BYTES of bins each
where few models leave cores free, up to GROUP_BYTES where many fill them - and
not with tasks or executors; there is no shuffle while one group holds all rows.

A round needs one pass a level.  As thousands of short passes run over the same
packed rows, they are RDD passes over NumPy blocks: a DataFrame pass with the
same work was measured at three times the time, all of it planning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, write_through
from .curves import auc as exact_auc

#: Bins of a feature; the last one is for missing values.
MAX_BINS = 256
BLOCK_ROWS = 65_536
#: Bins of a row group, with few models and with many (a scan of Spark gives 128 MB to a task).
LEAST_BYTES = 8 * 2 ** 20
GROUP_BYTES = 32 * 2 ** 20
#: Features of one partial histogram, and models of a slice of a pass at most.
CHUNK = 16
MODELS = 16
#: Rounds between two sets of margins made from the stored blocks (in between each follows from the last), and between two evaluations.
STORE_ROUNDS = 64
EVAL_ROUNDS = 64
PATIENCE = 256
MIN_GAIN = 1e-6

# Settings that a parameter set may leave out.
DEFAULTS = {"eta": 0.3, "max_depth": 6, "gamma": 0.0, "min_child_weight": 1.0, "lambda": 1.0, "subsample": 1.0, "colsample_bytree": 1.0,
            "booster": "gbtree", "rate_drop": 0.0, "skip_drop": 0.0, "sample_type": "uniform", "normalize_type": "tree"}


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2 i + 1 and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node that holds each row of ``bins`` (rows, features)."""
        n, d = bins.shape
        node, inner = np.arange(len(self.feature)), self.feature >= 0
        # Where a row goes from node i: entry 2 i for right, 2 i + 1 for left; leaves keep it.
        to = np.stack([np.where(inner, 2 * node + 2, node), np.where(inner, 2 * node + 1, node)], axis=1).ravel()
        feature, missing = np.maximum(self.feature, 0).astype(np.int64), self.missing_left.any()
        pos, flat, first = np.zeros(n, np.int64), bins.reshape(-1), np.arange(n) * d
        for level in range((len(node) + 1).bit_length() - 2):
            if not inner[2 ** level - 1:2 ** (level + 1) - 1].any():
                break
            b = flat.take(first + feature.take(pos))
            left = b <= self.cut.take(pos)
            if missing:
                left |= (b == MAX_BINS - 1) & self.missing_left.take(pos)
            pos = to.take(2 * pos + left)
        return pos

    def output(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.place(bins)]


@dataclass
class Booster:
    """A model: parameters, edges of the bins, trees and their weights; ``hold`` is the fold it is not trained on."""

    params: dict
    edges: list[np.ndarray]
    seed: int = 0
    hold: int | None = None
    trees: list[Tree] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    best_iteration: int | None = None

    def __post_init__(self):
        self.params = DEFAULTS | {k: v for k, v in self.params.items() if k in DEFAULTS}

    def draw(self, round_: int, what: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, round_, what])

    def features(self, round_: int) -> np.ndarray:
        d = len(self.edges)
        k = max(1, int(self.params["colsample_bytree"] * d))
        return np.sort(self.draw(round_, 1).permutation(d)[:k])

    def dropped(self, round_: int) -> list[int]:
        """Trees that take no part in this round's margins."""
        p, n = self.params, len(self.trees)
        if p["booster"] != "dart" or not n:
            return []
        r = self.draw(round_, 2)
        if r.random() < p["skip_drop"]:
            return []
        share = np.full(n, float(p["rate_drop"]))
        if p["sample_type"] == "weighted":
            w = np.array(self.weights)
            share = p["rate_drop"] * n * w / w.sum()
        return list(np.flatnonzero(r.random(n) < share))

    def add(self, tree: Tree, dropped: list[int]) -> None:
        """A new tree; with dropout it and the dropped ones are weighed down so that together they don't overshoot."""
        eta, k = self.params["eta"], len(dropped)
        new = 1.0
        if k:
            forest = self.params["normalize_type"] == "forest"
            new, old = (1 / (1 + eta), 1 / (1 + eta)) if forest else (1 / (k + eta), k / (k + eta))
            for i in dropped:
                self.weights[i] *= old
        self.trees.append(tree)
        self.weights.append(new)

    def margins(self, bins: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        out = np.zeros(len(bins))
        for t, w in zip(self.trees[first:last], self.weights[first:last]):
            out += w * t.output(bins)
        return out

    def used(self) -> int:
        return len(self.trees) if self.best_iteration is None else self.best_iteration + 1


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-m))


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: how many edges are at or below it; missing values go to the last bin."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), MAX_BINS - 1, np.searchsorted(e, x[:, j], side="right"))
    return out


def chosen(uid: np.ndarray, seed: int, round_: int, rate: float) -> np.ndarray:
    """Rows of a round's sample: a hash of row, seed and round, the same however rows are dealt."""
    if rate >= 1:
        return np.ones(len(uid), bool)
    with np.errstate(over="ignore"):
        z = uid.view(np.uint64) + np.uint64((seed * 1_000_003 + round_ + 1) & (2 ** 63 - 1)) * np.uint64(0x9E3779B97F4A7C15)
        for s, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(s))) * np.uint64(k)
        z ^= z >> np.uint64(31)
    return z < np.uint64(int(rate * 2 ** 64))


def best_splits(hist: np.ndarray, features: np.ndarray, cuts: np.ndarray, lam: float, least: float) -> np.ndarray:
    """Best split of each node: rows (gain, feature, cut, missing_left, GL, HL, G, H) from hist (2, nodes, features, bins).

    The gain is GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda); both
    sides need a hessian of ``least``.  A feature has ``cuts`` edges.  Ties:
    smallest feature, then cut.
    """
    g, h = hist
    beyond = np.arange(MAX_BINS - 1) >= cuts[:, None]
    total_g, total_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
    G, H = total_g[:, None, None], total_h[:, None, None]
    base = G * G / (H + lam)
    out = np.zeros((hist.shape[1], 8))
    out[:, 0], out[:, 6], out[:, 7] = -np.inf, total_g, total_h
    left_g, left_h = np.cumsum(g[..., :-1], axis=2), np.cumsum(h[..., :-1], axis=2)
    for missing_left in (False, True):
        gl, hl = left_g, left_h
        if missing_left:
            if not h[..., -1].any():
                break
            gl, hl = left_g + g[..., -1:], left_h + h[..., -1:]
        gr, hr = G - gl, H - hl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl * gl / (hl + lam) + gr * gr / (hr + lam) - base
        gain[(hl < least) | (hr < least) | (hl <= 0) | (hr <= 0) | beyond] = -np.inf
        flat = gain.reshape(len(gain), -1)
        at = flat.argmax(axis=1)
        i = np.arange(len(flat))
        better = flat[i, at] > out[:, 0]
        f, cut = np.divmod(at, gain.shape[2])
        row = np.stack([flat[i, at], features[f], cut, np.full(len(at), float(missing_left)), gl[i, f, cut], hl[i, f, cut], total_g, total_h], axis=1)
        out[better] = row[better]
    return out


class _Growing:
    """A tree in growth: its open nodes of the current level."""

    def __init__(self, model: Booster, round_: int):
        self.model, self.round = model, round_
        self.tree, self.open, self.depth = Tree.empty(int(model.params["max_depth"])), [0], 0
        self.features, self.dropped = model.features(round_), model.dropped(round_)

    def task(self) -> dict:
        """What a pass needs to know: this tree so far, its open nodes, the sample of rows and features."""
        m, p = self.model, self.model.params
        slot = np.full(len(self.tree.feature), -1)
        slot[self.open] = np.arange(len(self.open))
        return {"weights": np.array(m.weights), "dropped": self.dropped, "dart": p["booster"] == "dart", "tree": self.tree, "slot": slot,
                "features": self.features, "cuts": np.array([len(m.edges[f]) for f in self.features]), "hold": m.hold, "seed": m.seed, "round": self.round, "subsample": p["subsample"],
                "lambda": p["lambda"], "least": max(float(p["min_child_weight"]), 0.0)}

    def level(self, best: np.ndarray) -> bool:
        """Splits or closes the open nodes; True while the tree grows."""
        p, t, nxt = self.model.params, self.tree, []
        leaf = lambda g, h: -p["eta"] * g / (h + p["lambda"]) if h + p["lambda"] > 0 else 0.0
        for node, (gain, f, cut, ml, gl, hl, g, h) in zip(self.open, best):
            if gain <= max(MIN_GAIN, p["gamma"]):
                t.value[node] = leaf(g, h)
                continue
            t.feature[node], t.cut[node], t.missing_left[node], t.gain[node] = int(f), int(cut), bool(ml), gain
            left = 2 * node + 1
            t.value[left], t.value[left + 1] = leaf(gl, hl), leaf(g - gl, h - hl)
            nxt += [left, left + 1]
        self.open, self.depth = nxt, self.depth + 1
        return bool(nxt) and self.depth < p["max_depth"]


def _margin(state: np.ndarray, t: dict) -> np.ndarray:
    """Margins of a round: the stored ones; of a dart model the trees' outputs without the dropped."""
    if not t["dart"]:
        return state
    w = t["weights"].copy()
    w[t["dropped"]] = 0.0
    return w @ state if len(state) else np.zeros(state.shape[1])


def _histograms(blocks: Iterator, tasks: dict[int, dict], jobs: list[tuple]) -> Iterator:
    """((model, first feature, end), histogram) of a group's rows for the models and shares of features in ``jobs``."""
    held = [(unpack_block(raw), states) for raw, states in blocks]              # a group: its bytes are bounded
    for m, part, parts in jobs:
        t = tasks.get(m)
        if t is None:
            continue
        k, n, rows = len(t["features"]), int(t["slot"].max()) + 1, []
        lo, hi = k * part // parts, k * (part + 1) // parts
        if lo == hi:
            continue
        for block, states in held:
            slot = t["slot"].take(t["tree"].place(block["bins"]))
            use = (slot >= 0) & chosen(block["uid"], t["seed"], t["round"], t["subsample"])
            if t["hold"] is not None:
                use &= block["fold"] != t["hold"]
            at = np.flatnonzero(use)
            if len(at):
                p, y, w = sigmoid(_margin(states[m], t)[at]), block["y"][at], block["w"][at]
                rows.append((block["bins"], at, slot[at] * MAX_BINS, w * (p - y), w * p * (1.0 - p)))
        for c in range(lo, hi if rows else lo, CHUNK):
            end = min(c + CHUNK, hi)
            hist = np.zeros((2, n, end - c, MAX_BINS))
            for bins, at, first, g, h in rows:
                for j, f in enumerate(t["features"][c:end]):
                    key = first + bins[:, f].take(at)
                    for side, x in enumerate((g, h)):
                        hist[side, :, j] += np.bincount(key, x, n * MAX_BINS).reshape(n, MAX_BINS)
            yield (m, c, end), hist


class Data:
    """Binned rows of a table as stored blocks: the training set of any number of models."""

    def __init__(self, df: DataFrame, key: str, features: str = "features", label: str = "labels", weight: str | None = None,
                 fold: str | None = None, max_bins: int = MAX_BINS, train: str | None = None):
        """``train``: a condition on rows whose values set the edges (all rows without it)."""
        self.spark = df.sparkSession
        ensure_checkpoint_dir(self.spark)
        x = F.col(features).cast("array<double>")
        rows = df.select(F.xxhash64(key).alias("uid"), F.col(label).cast("double").alias("y"),
                         (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                         (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"), x.alias("x"), F.expr(train or "true").alias("t"))
        rows = write_through(rows.filter("y IS NOT NULL AND x IS NOT NULL"), "boost-rows")
        self.edges = quantile_edges(rows.filter("t"), max_bins)
        self.blocks = write_through(pack_blocks(rows, self.edges), "boost-blocks")
        rdd = self.blocks.select("block").rdd.map(lambda r: bytes(r[0]))
        self.rdd = rdd.coalesce(max(1, min(rdd.getNumPartitions(), self.blocks.count())))
        self.bytes = rows.count() * len(self.edges)

    def staged(self, models: Sequence[Booster], first: int, last: int | None = None, held: bool = True) -> DataFrame:
        """(model, round, labels, weight, score): scores after every round from ``first`` on, of each model's held-out rows."""
        picked = [(i, m.hold, m.trees, m.weights) for i, m in enumerate(models)]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for raw in b.column(0):
                    block = unpack_block(raw.as_py())
                    for i, hold, trees, weights in picked:
                        use = np.ones(len(block["y"]), bool) if not held else block["fold"] == (-2 if hold is None else hold)
                        bins, y, w = block["bins"][use], block["y"][use], block["w"][use]
                        end = len(trees) if last is None else min(last, len(trees))
                        margin = np.zeros(len(bins))
                        for r in range(end):
                            margin += weights[r] * trees[r].output(bins)
                            if r >= first and len(bins):
                                n = len(bins)
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, r, np.int32)), pa.array(y.astype(np.int32)),
                                     pa.array(w), pa.array(sigmoid(margin))], ["model", "round", "labels", "weight", "score"])

        return self.blocks.select("block").mapInArrow(task, "model int, round int, labels int, weight double, score double")

    def curves(self, models: Sequence[Booster], first: int, last: int | None = None) -> list[dict]:
        """Per model and round: exact AUC and error at 0.5 on the model's held-out rows (models x rounds rows)."""
        s = write_through(self.staged(models, first, last), "boost-staged")
        auc = exact_auc(s, by=["model", "round"]).select("model", "round", "auc")
        err = s.groupBy("model", "round").agg(F.avg(((F.col("score") > 0.5).cast("int") != F.col("labels")).cast("double")).alias("error"))
        return [r.asDict() for r in auc.join(err, ["model", "round"]).orderBy("model", "round").collect()]

    def grow(self, models: Sequence[Booster], targets: Sequence[int]) -> None:
        """Adds rounds to each model until it has its target; all models share the passes."""
        state, open_, deal, groups, age = None, [], [], 1, 0
        while live := [i for i, (m, n) in enumerate(zip(models, targets)) if len(m.trees) < n]:
            if state is None or live != open_ or age >= STORE_ROUNDS:
                groups = self._groups(len(live))
                open_, deal, age, source = live, self._deal(models, live, groups), 0, None
            else:
                source = state
            old, state = state, self._states(models, deal, groups, source)
            age += 1
            growing = {i: _Growing(models[i], len(models[i].trees)) for i in live}
            left = dict(growing)
            while left:
                tasks = {i: g.task() for i, g in left.items()}
                best = self._level(state, tasks, deal, groups)
                # Without a row left to train on, the node stays a leaf of 0.
                left = {i: g for i, g in left.items() if i in best and g.level(best[i])}
            if old is not None:
                old.unpersist()
            for g in growing.values():
                g.model.add(g.tree, g.dropped)
        if state is not None:
            state.unpersist()

    def _groups(self, models: int) -> int:
        """Row groups of a pass: by bytes alone, fewer while models keep the cores busy."""
        most, least = (-(-self.bytes // b) for b in (LEAST_BYTES, GROUP_BYTES))
        return max(1, min(self.rdd.getNumPartitions(), most, max(least, -(-self.spark.sparkContext.defaultParallelism // models))))

    def _deal(self, models: Sequence[Booster], live: list[int], groups: int) -> list[list[tuple]]:
        """Slices of a pass, each with the (model, part, parts) whose features it adds up: even shares by depth."""
        want = max(1, self.spark.sparkContext.defaultParallelism // groups, -(-len(live) // MODELS))
        parts = max(1, min(-(-want // len(live)), len(self.edges)))
        jobs = sorted(((int(models[i].params["max_depth"]), i, k) for i in live for k in range(parts)), reverse=True)
        slices: list[list] = [[0, []] for _ in range(min(want, len(jobs)))]
        for depth, i, k in jobs:
            least = min(slices, key=lambda s: s[0])
            least[0] += depth
            least[1].append((i, k, parts))
        return [s[1] for s in slices]

    def _states(self, models: Sequence[Booster], deal: list[list[tuple]], groups: int, source):
        """A copy of all groups for every slice: blocks and the margins of its models, from ``source`` and the last trees or from all."""
        who = [sorted({i for i, *_ in jobs}) for jobs in deal]
        last = -1 if source is not None else 0
        shared = self.spark.sparkContext.broadcast({i: (models[i].trees[last:], models[i].weights[last:], models[i].params["booster"] == "dart")
                                                    for w in who for i in w})

        def task(p: int, blocks: Iterator) -> Iterator:
            for b in blocks:
                raw, states = (b, {}) if last == 0 else b
                block = unpack_block(raw)
                yield raw, {i: _state(block, *shared.value[i], states.get(i)) for i in who[p // groups]}

        rdd = source if source is not None else self.spark.sparkContext.union([self.rdd.coalesce(groups)] * len(deal))
        return rdd.mapPartitionsWithIndex(task).persist(StorageLevel.MEMORY_AND_DISK)

    def _level(self, state, tasks: dict[int, dict], deal: list[list[tuple]], groups: int) -> dict[int, np.ndarray]:
        # What a pass needs travels with its tasks: a broadcast of its own would cost more than the pass.
        parts = state.mapPartitionsWithIndex(lambda p, blocks: _histograms(blocks, tasks, deal[p // groups]))
        if groups > 1:
            parts = parts.reduceByKey(lambda a, b: a + b, min(state.getNumPartitions(), 4 * len(tasks)))

        def best(item):
            (m, c, end), hist = item
            t = tasks[m]
            return m, best_splits(hist, t["features"][c:end], t["cuts"][c:end], t["lambda"], t["least"])

        out: dict[int, np.ndarray] = {}
        for m, b in parts.map(best).collect():               # eight numbers a node and feature chunk
            if m in out:
                a = out[m]
                better = (b[:, 0] > a[:, 0]) | ((b[:, 0] == a[:, 0]) & (b[:, 1] < a[:, 1]))
                out[m] = np.where(better[:, None], b, a)
            else:
                out[m] = b
        return out


def _state(block: dict, trees: list[Tree], weights: list[float], dart: bool, before: np.ndarray | None) -> np.ndarray:
    """Margins of a block's rows (of a dart model: each tree's outputs), from those before these trees."""
    n = len(block["y"])
    if dart:
        new = np.array([t.output(block["bins"]) for t in trees]).reshape(len(trees), n)
        return new if before is None else np.vstack([before, new])
    out = np.zeros(n) if before is None else before
    for t, w in zip(trees, weights):
        out = out + w * t.output(block["bins"])
    return out


def quantile_edges(rows: DataFrame, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Edges of every feature: its distinct quantiles, at most ``max_bins`` - 2 of them (features x bins numbers)."""
    probs = [i / (max_bins - 1) for i in range(1, max_bins - 1)]
    v = rows.select(F.posexplode("x").alias("feature", "v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    got = {r["feature"]: r["q"] for r in v.groupBy("feature").agg(F.percentile_approx("v", probs, 100 * max_bins).alias("q")).collect()}
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return [np.unique(np.array(got.get(j, []), dtype=np.float64)) for j in range(d)]


PARTS = (("uid", np.int64), ("y", np.float64), ("w", np.float64), ("fold", np.int32), ("bins", np.uint8))


def unpack_block(raw: bytes) -> dict:
    n, d = np.frombuffer(raw, np.int64, 2)
    at, out = 16, {}
    for name, kind in PARTS:
        count = n * d if name == "bins" else n
        out[name] = np.frombuffer(raw, kind, count, at)
        at += count * np.dtype(kind).itemsize
    out["bins"] = out["bins"].reshape(n, d)
    return out


def matrix(col: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as a matrix; missing values and missing columns are NaN."""
    out = np.full((len(col), d), np.nan)
    for i, x in enumerate(col.to_pylist()):
        x = x or []
        out[i, :min(d, len(x))] = [np.nan if v is None else v for v in x[:d]]
    return out


def pack_blocks(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Binned rows, up to BLOCK_ROWS of a partition in one packed row."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def block() -> pa.RecordBatch:
            joined = {name: np.concatenate([h[name] for h in held]) for name, _ in PARTS}
            raw = np.array([len(joined["y"]), len(edges)], np.int64).tobytes() + b"".join(joined[name].astype(kind).tobytes() for name, kind in PARTS)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["block"])

        for b in batches:
            if b.num_rows:
                col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "y", "w", "fold")}
                held.append(col | {"bins": to_bins(matrix(b.column("x"), len(edges)), edges)})
                if sum(len(h["y"]) for h in held) >= BLOCK_ROWS:
                    yield block()
        if held:
            yield block()

    return rows.select("uid", "y", "w", "fold", "x").mapInArrow(task, "block binary")


def train(data: Data, params: dict, rounds: int, hold: int | None = None, seed: int = 42, patience: int | None = PATIENCE,
          model: Booster | None = None) -> tuple[Booster, list[dict]]:
    """L1: a model of ``rounds`` trees and its curve (round, auc, error on the held-out fold).

    Every EVAL_ROUNDS rounds the exact AUC after each new round is computed; once
    ``patience`` rounds have passed without a higher one, training stops, trees
    beyond that round are dropped and ``best_iteration`` is the first round with
    the highest AUC.  ``model`` continues from where it ends.
    """
    m = model or Booster(params, data.edges, seed, hold)
    curve: list[dict] = []
    while len(m.trees) < rounds:
        first = len(m.trees)
        data.grow([m], [min(rounds, first + EVAL_ROUNDS)])
        if hold is None:
            continue
        curve += data.curves([m], first if curve or model else 0)
        best = max(curve, key=lambda r: (r["auc"] if r["auc"] is not None else -1.0, -r["round"]))["round"]
        m.best_iteration = best
        if patience is not None and len(m.trees) - 1 - best >= patience:
            end = best + patience + 1
            m.trees, m.weights = m.trees[:end], m.weights[:end]
            curve = [r for r in curve if r["round"] < end]
            break
    return m, curve


def cross_validated(data: Data, draws: Sequence[dict], rounds: int, k: int, seed: int = 42) -> list[float]:
    """L4: mean exact AUC over ``k`` folds of each parameter draw; all draws and folds grow in the same passes."""
    models = [Booster(p, data.edges, seed, hold) for p in draws for hold in range(k)]
    data.grow(models, [rounds] * len(models))
    got = {r["model"]: r["auc"] for r in data.curves(models, rounds - 1)}
    return [float(np.mean([got[i * k + f] for f in range(k)])) for i in range(len(draws))]


def score(model: Booster, df: DataFrame, features: str = "features", name: str = "score") -> DataFrame:
    """Probability of class 1 by the model's trees up to its best iteration."""
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        bins = to_bins(matrix(pa.array(x.tolist(), pa.list_(pa.float64())), len(model.edges)), model.edges)
        return pd.Series(sigmoid(model.margins(bins, 0, model.used())))

    ensure_checkpoint_dir(df.sparkSession)
    return df.withColumn(name, run(F.col(features).cast("array<double>")))


NODES = ("tree int, node int, feature int, cut int, threshold double, missing_left boolean, value double, gain double, weight double")


def tree_table(spark: SparkSession, model: Booster) -> DataFrame:
    """Nodes of all trees: splits with feature, threshold (left: below it) and gain, leaves with value (feature null)."""
    rows = []
    for i, (t, w) in enumerate(zip(model.trees, model.weights)):
        live = [0]
        while live:
            n = live.pop()
            f = int(t.feature[n])
            if f < 0:
                rows.append((i, n, None, None, None, None, float(t.value[n]), None, float(w)))
            else:
                rows.append((i, n, f, int(t.cut[n]), float(model.edges[f][t.cut[n]]), bool(t.missing_left[n]), None, float(t.gain[n]), float(w)))
                live += [2 * n + 1, 2 * n + 2]
    return spark.createDataFrame(rows, NODES)


def split_counts(nodes: DataFrame, top: int = 20) -> DataFrame:
    """Number of splits of each feature, the ``top`` most frequent (ties: smallest feature)."""
    return nodes.filter("feature IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("splits")) \
        .orderBy(F.col("splits").desc(), "feature").limit(top)


def hyperband(data: Data, draw, hold: int, max_iter: int = 81, eta: int = 3, rounds_per_unit: int = 1, seed: int = 42) -> list[tuple]:
    """Rows (bracket, rung, config, resource, auc); a resource of r is r * ``rounds_per_unit`` trees.

    All brackets run side by side: in a step every live configuration grows to
    its rung's resource - survivors go on from the trees they have - and its
    exact AUC on the held-out fold decides who stays (the highest; ties: the
    smaller configuration).  ``draw(bracket, n)`` gives n parameter sets.
    """
    from .models import hyperband_schedule
    live, results = {}, []
    for s, n, r in hyperband_schedule(max_iter, eta):
        live[s] = {"rung": 0, "n": n, "r": r, "models": {i: Booster(p, data.edges, seed, hold) for i, p in enumerate(draw(s, n))}}
    while live:
        # The brackets whose next rung is nearest, so that no pass waits for a longer one.
        goal = {s: max(1, round(b["r"] * eta ** b["rung"] * rounds_per_unit)) for s, b in live.items()}
        now = [s for s in live if goal[s] == min(goal.values())]
        who = [(s, i, m) for s in now for i, m in live[s]["models"].items()]
        data.grow([m for *_, m in who], [goal[s] for s, *_ in who])
        got = {r["model"]: r["auc"] for r in data.curves([m for *_, m in who], min(goal.values()) - 1)}
        for s in now:
            b = live[s]
            scored = [(i, got[j]) for j, (x, i, _) in enumerate(who) if x == s]
            results += [(s, b["rung"], i, float(b["r"] * eta ** b["rung"]), float(a)) for i, a in scored]
            keep = max(int(int(b["n"] * eta ** -b["rung"] + 1e-9) / eta), 1)
            best = sorted(scored, key=lambda t: (-t[1], t[0]))[:keep]
            b["models"] = {i: b["models"][i] for i, _ in best}
            b["rung"] += 1
            if b["rung"] > s:
                del live[s]
    return results
