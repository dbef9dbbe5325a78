"""Classifiers on Spark ML.

The reference trains boosted trees, SVMs and dense networks on one machine;
here the same roles are played by Spark ML estimators, whose fitting is
distributed (tree statistics and gradients are tree-aggregated across
executors).  Features stay a JVM vector built with ``array_to_vector`` /
``VectorAssembler`` -- no Python UDF on the data path.  Model gaps (no DART,
no RBF kernel, fixed sigmoid hidden units in the MLP) are documented, not
emulated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LinearSVC,
                                       MultilayerPerceptronClassifier, OneVsRest)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_hex
from ..session import scratch_path, write_through
from .curves import auc as exact_auc

# Default and deep boosted-tree settings and the ranges of the random search.
DEFAULT_PARAMS = {"eta": 0.1, "max_depth": 6, "subsample": 0.8, "colsample_bytree": 0.9, "gamma": 1.6, "min_child_weight": 1}
DEEP_PARAMS = {"eta": 0.1, "max_depth": 8, "subsample": 0.75, "colsample_bytree": 0.85, "gamma": 2.5, "min_child_weight": 0.4}
SEARCH_SPACE = {"eta": ("uniform", 0.01, 0.17), "gamma": ("uniform", 0.05, 2.5), "min_child_weight": ("uniform", 0, 2),
                "max_depth": ("quniform", 3, 9, 1), "subsample": ("uniform", 0.7, 1), "colsample_bytree": ("uniform", 0.7, 1)}
CV_SPACE = {"eta": ("uniform", 0.05, 0.2), "colsample_bytree": ("uniform", 0.8, 0.995), "subsample": ("uniform", 0.8, 0.995),
            "max_depth": ("choice", (3, 4, 5, 6)), "min_child_weight": ("choice", (1, 2, 3))}
ROUNDS = 350
SVC_C = tuple(10.0 ** k for k in range(-2, 11))


def param_sets(deep: bool = False) -> dict:
    """L2: default / deep parameter set."""
    return dict(DEEP_PARAMS if deep else DEFAULT_PARAMS)


def spark_params(params: dict, n_rows: int | None = None) -> dict:
    """Boosted-tree settings under GBTClassifier's names.

    ``gamma`` is a loss reduction summed over a node's rows, Spark's
    ``minInfoGain`` one averaged over them, so it is divided by ``n_rows``
    (left at 0 where that is unknown); ``min_child_weight`` becomes whole rows.
    """
    out = {}
    for k, v in params.items():
        if k == "eta":
            out["stepSize"] = float(v)
        elif k == "max_depth":
            out["maxDepth"] = int(v)
        elif k == "subsample":
            out["subsamplingRate"] = float(v)
        elif k == "colsample_bytree":
            out["featureSubsetStrategy"] = str(float(v))
        elif k == "gamma":
            out["minInfoGain"] = float(v) / n_rows if n_rows else 0.0
        elif k == "min_child_weight":
            out["minInstancesPerNode"] = max(1, round(float(v)))
        elif k != "draw":
            out[k] = v
    return out


def with_vector(df: DataFrame, features: str = "features", out: str = "fvec") -> DataFrame:
    """array<float|double> features -> ML vector (JVM-side)."""
    return df.withColumn(out, array_to_vector(F.col(features).cast("array<double>")))


def gbt(params: dict | None = None, features: str = "fvec", label: str = "labels", seed: int = 42,
        validation_col: str | None = None, weight_col: str | None = None) -> GBTClassifier:
    """L1: boosted trees; with ``validation_col`` Spark stops early on the held-out rows."""
    p = {"maxIter": ROUNDS} | spark_params(DEFAULT_PARAMS) | (params or {})
    est = GBTClassifier(featuresCol=features, labelCol=label, seed=seed, **p)
    if validation_col:
        est.setValidationIndicatorCol(validation_col)
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def score(model: Model, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1 as a plain double column."""
    out = model.transform(df)
    return out.withColumn(name, vector_to_array(F.col("probability")).getItem(1))


def random_params(spark: SparkSession, n: int, seed: int = 42, space: dict | None = None) -> DataFrame:
    """L3: n parameter draws as a table, each value a function of md5(seed:draw:name).

    ``space`` maps name -> ("uniform", lo, hi) | ("quniform", lo, hi, q) | ("choice", [..]).
    """
    space = space or SEARCH_SPACE
    d = spark.range(n).withColumnRenamed("id", "draw")
    for name, spec in space.items():
        u = F.conv(F.substring(hash_hex(seed, F.col("draw"), F.lit(name)), 1, 12), 16, 10).cast("double") \
            / F.lit(float(16 ** 12))
        if spec[0] == "uniform":
            v = F.lit(float(spec[1])) + u * F.lit(float(spec[2] - spec[1]))
        elif spec[0] == "quniform":
            v = F.round((F.lit(float(spec[1])) + u * F.lit(float(spec[2] - spec[1]))) / spec[3]) * spec[3]
        else:
            choices = F.array(*[F.lit(c) for c in spec[1]])
            v = F.element_at(choices, (F.floor(u * len(spec[1])) + 1).cast("int"))
        d = d.withColumn(name, v)
    return d


def cross_validate(est, maps: list[dict], df: DataFrame, fold_col: str, label: str = "labels", k: int = 5,
                   parallelism: int = 4):
    """L4: k-fold CV (folds from a column, see ``sample.stratified_folds``), exact AUC."""
    df = write_through(df, "cv-input")         # every fold of every map re-reads it
    ev = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col, numFolds=k,
                        parallelism=parallelism, seed=42)
    return cv.fit(df)


def random_search_cv(spark: SparkSession, df: DataFrame, key: str, n_iter: int = 25, k: int = 5, rounds: int = ROUNDS,
                     seed: int = 42, label: str = "labels", space: dict | None = None) -> DataFrame:
    """L4: ``n_iter`` random draws, each cross-validated on ``k`` stratified folds: the draw and its mean exact AUC."""
    from .sample import stratified_folds
    space = space or CV_SPACE
    rows = [r.asDict() for r in random_params(spark, n_iter, seed, space).orderBy("draw").collect()]     # n_iter rows
    n = df.count()
    est = gbt({"maxIter": rounds}, label=label)
    maps = [{est.getParam(p): v for p, v in spark_params(r, n).items()} for r in rows]
    cvm = cross_validate(est, maps, stratified_folds(df, label, key, k, seed), "fold", label, k)
    out = [(int(r["draw"]), *(float(r[c]) for c in space), float(a)) for r, a in zip(rows, cvm.avgMetrics)]
    return spark.createDataFrame(out, "draw int, " + ", ".join(f"{c} double" for c in space) + ", mean_auc double")


def grid_search_svc(spark: SparkSession, df: DataFrame, key: str, c_range: Sequence[float] = SVC_C, n_splits: int = 4,
                    test_size: float = 0.25, seed: int = 28, label: str = "labels", max_iter: int = 50,
                    workers: int = 4) -> DataFrame:
    """Grid search of a linear SVM over C on repeated stratified shuffle splits: C, splits, mean exact AUC.

    The kernel width of the original grid has no counterpart in a linear SVM;
    C becomes ``regParam = 1 / (C n)``.
    """
    from .sample import stratified_splits
    path = scratch_path(spark, "svc-splits")
    stratified_splits(df.select(*dict.fromkeys([*([key] if isinstance(key, str) else key), "fvec", label])), label, key, n_splits, test_size, seed) \
        .write.partitionBy("repeat", "is_test").parquet(path)                # a fit reads its own rows only
    splits = spark.read.parquet(path)
    sizes = {r["repeat"]: r["count"] for r in splits.filter("is_test = 0").groupBy("repeat").count().collect()}
    jobs, scored = [(c, i) for c in c_range for i in range(n_splits)], []

    def fit(job):
        c, i = job
        est = LinearSVC(featuresCol="fvec", labelCol=label, regParam=1.0 / (c * sizes[i]), maxIter=max_iter)
        return est.fit(splits.filter((F.col("repeat") == i) & (F.col("is_test") == 0)))

    with ThreadPoolExecutor(max_workers=workers) as ex:
        models = dict(zip(jobs, ex.map(fit, jobs)))
    for i in range(n_splits):
        s = splits.filter((F.col("repeat") == i) & (F.col("is_test") == 1)).select("fvec", label)
        for k, c in enumerate(c_range):
            s = models[c, i].setRawPredictionCol(f"_r{k}").setPredictionCol(f"_p{k}").transform(s).drop(f"_p{k}")
        each = [F.struct(F.lit(float(c)).alias("C"), F.lit(i).alias("split"), vector_to_array(f"_r{k}").getItem(1).alias("score")) for k, c in enumerate(c_range)]
        scored.append(s.select(label, F.inline(F.array(*each))))
    # One table and one curve computation for all machines.
    got = {(r["C"], r["split"]): r["auc"] for r in exact_auc(reduce(DataFrame.unionByName, scored), label=label, by=["C", "split"]).collect()}
    scores = [got[j] for j in jobs]
    out = [(float(c), n_splits, sum(a for a, (d, _) in zip(scores, jobs) if d == c) / n_splits) for c in c_range]
    return spark.createDataFrame(out, "C double, n_splits int, mean_auc double")


def split_importance(model: GBTClassificationModel, path: str, feature_names: Sequence[str] | None = None,
                     top: int = 20) -> DataFrame:
    """Number of splits per feature (the reference's default importance), top n.

    The saved model's node table is Parquet; internal nodes are those with a
    split (leftChild >= 0).  This is a distributed group-by over all trees.
    """
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    nodes = spark.read.parquet(path + "/data")
    internal = nodes.filter(F.col("nodeData.leftChild") >= 0)
    cnt = internal.groupBy(F.col("nodeData.split.featureIndex").alias("feature_index")) \
                  .agg(F.count(F.lit(1)).alias("splits"))
    if feature_names:
        names = spark.createDataFrame([(i, n) for i, n in enumerate(feature_names)],
                                      "feature_index int, feature string")
        cnt = cnt.join(names, "feature_index", "left")
    return cnt.orderBy(F.col("splits").desc(), F.col("feature_index")).limit(top)


def hyperband_schedule(max_iter: int = 81, eta: int = 3, skip_last: bool = False) -> list[tuple[int, int, float]]:
    """Brackets (s, n, r) of Hyperband; ``skip_last`` drops bracket s=0 only."""
    s_max = int(math.floor(math.log(max_iter) / math.log(eta) + 1e-9))
    B = (s_max + 1) * max_iter
    out = []
    for s in range(s_max, -1, -1):
        if skip_last and s == 0:
            continue
        n = int(math.ceil(B / max_iter / (s + 1) * eta ** s))
        r = max_iter * eta ** (-s)
        out.append((s, n, r))
    return out


def hyperband(spark: SparkSession, train: DataFrame, valid: DataFrame, max_iter: int = 81, eta: int = 3,
              make: Callable[[dict, int], object] | None = None, seed: int = 42, label: str = "labels",
              workers: int = 4) -> DataFrame:
    """Hyperband over boosted-tree configurations.

    The driver loop only schedules: each rung's configurations are fitted
    concurrently (Spark jobs from a thread pool), scored with the exact AUC
    on the validation frame, and the best floor(n_i / eta) survive (highest
    AUC, fixing the reference's ascending sort).  Returns one row per
    evaluation: bracket, rung, config, resource, auc.
    """
    n_rows = train.count()
    make = make or (lambda p, r: gbt({**spark_params(p, n_rows), "maxIter": max(1, int(round(r)))}, seed=seed))
    # Dozens of fits read these frames: store them once (vector columns included).
    train = write_through(train, "hyperband-train")
    valid = write_through(valid, "hyperband-valid")
    results = []
    sched = hyperband_schedule(max_iter, eta)
    for s, n, r in sched:
        cfg = random_params(spark, n, seed=seed * 1000 + s).collect()   # n rows, bounded by the schedule
        configs = [dict(row.asDict()) for row in cfg]
        for i in range(s + 1):
            n_i = int(math.floor(n * eta ** (-i)))
            r_i = r * eta ** i

            def run(c):
                p = {k: v for k, v in c.items() if k != "draw"}
                m = make(p, r_i).fit(train)
                a = exact_auc(score(m, valid), label=label).first()["auc"]
                return c["draw"], a
            with ThreadPoolExecutor(max_workers=workers) as ex:
                scored = list(ex.map(run, configs))
            for draw, a in scored:
                results.append((s, i, int(draw), float(r_i), float(a)))
            keep = max(int(n_i / eta), 1)
            best = sorted(scored, key=lambda t: (-t[1], t[0]))[:keep]
            ids = {d for d, _ in best}
            configs = [c for c in configs if c["draw"] in ids]
    schema = T.StructType([T.StructField("bracket", T.IntegerType()), T.StructField("rung", T.IntegerType()),
                           T.StructField("config", T.IntegerType()), T.StructField("resource", T.DoubleType()),
                           T.StructField("auc", T.DoubleType())])
    return spark.createDataFrame(results, schema)


def fit_mixture(df: DataFrame, col: str, k: int = 2, seed: int = 42) -> tuple[list, list, list]:
    """M9 parameters: a k-component Gaussian mixture of one column (Spark ML EM).

    Returns (weights, means, sigmas) -- k numbers each, for
    ``functions.scalar.gmm_log_density``.
    """
    from pyspark.ml.clustering import GaussianMixture
    v = df.select(array_to_vector(F.array(F.col(col).cast("double"))).alias("_v"))
    m = GaussianMixture(featuresCol="_v", k=k, seed=seed).fit(v)
    g = m.gaussiansDF.collect()                      # k rows
    means = [float(r["mean"][0]) for r in g]
    sigmas = [float(r["cov"].toArray()[0][0]) ** 0.5 for r in g]
    return [float(w) for w in m.weights], means, sigmas


def class_weights(df: DataFrame, label: str = "labels", name: str = "weight") -> DataFrame:
    """G3 -> weightCol: positives weighted by negatives/positives, negatives by 1."""
    n = df.agg(F.struct(F.sum(F.lit(1) - F.col(label)).alias("neg"), F.sum(F.col(label)).alias("pos")).alias("s"))
    d = df.withColumn("_w", n.scalar())
    return d.withColumn(name, F.when(F.col(label) == 1, F.try_divide(F.col("_w.neg").cast("double"), F.col("_w.pos")))
                        .otherwise(F.lit(1.0))).drop("_w")


def ovr_svc(features: str = "fvec", label: str = "label", reg: float = 0.01, max_iter: int = 50) -> OneVsRest:
    """One-vs-rest linear SVM (the RBF kernel has no Spark counterpart)."""
    return OneVsRest(classifier=LinearSVC(regParam=reg, maxIter=max_iter), featuresCol=features, labelCol=label)


def mlp(layers: Sequence[int], features: str = "fvec", label: str = "labels", seed: int = 42,
        max_iter: int = 100) -> MultilayerPerceptronClassifier:
    """Dense feed-forward classifier (sigmoid hidden layers, softmax output)."""
    return MultilayerPerceptronClassifier(layers=list(layers), featuresCol=features, labelCol=label, seed=seed,
                                          maxIter=max_iter)


def grid(est, **axes) -> list[dict]:
    """Full parameter grid."""
    b = ParamGridBuilder()
    for k, vals in axes.items():
        b = b.addGrid(est.getParam(k), list(vals))
    return b.build()


__all__ = ["param_sets", "with_vector", "gbt", "score", "random_params", "cross_validate", "split_importance",
           "hyperband_schedule", "hyperband", "ovr_svc", "mlp", "grid", "random_search_cv", "grid_search_svc"]
