"""Model invariants: better than chance, repeatable, save/load identical, hyperband schedule."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from sigbg.operators import curves
from sigbg.operators import models as mdl
from sigbg.plans.models import _prepared


def test_gbt_beats_chance_and_is_repeatable(spark):
    v = _prepared(spark, SF_SMALL)
    m1 = mdl.gbt({"maxIter": 10, "maxDepth": 3}).fit(v)
    m2 = mdl.gbt({"maxIter": 10, "maxDepth": 3}).fit(v)
    s1 = mdl.score(m1, v).select("vec_id", F.col("score").alias("a"))
    s2 = mdl.score(m2, v).select("vec_id", F.col("score").alias("b"))
    assert s1.join(s2, "vec_id").filter("a != b").count() == 0
    assert curves.auc(mdl.score(m1, v)).first()["auc"] > 0.7      # training AUC, well above chance


def test_roundtrip_query(spark):
    import __spark_entry__ as ent
    r = ent.queries()["s13_model_roundtrip"](spark, SF_SMALL).first()
    assert r["n"] == r["n_equal"] and r["n"] > 0


def test_hyperband_schedule():
    assert mdl.hyperband_schedule(81, 3) == [(4, 81, 1.0), (3, 34, 3.0), (2, 15, 9.0), (1, 8, 27.0), (0, 5, 81.0)]
    assert [s for s, _, _ in mdl.hyperband_schedule(81, 3, skip_last=True)] == [4, 3, 2, 1]


def test_random_params_repeatable(spark):
    a = mdl.random_params(spark, 5, seed=1).collect()
    b = mdl.random_params(spark, 5, seed=1).collect()
    assert a == b
    assert all(3 <= r["max_depth"] <= 9 and 0.01 <= r["eta"] <= 0.17 and 0.05 <= r["gamma"] <= 2.5 for r in a)
    assert mdl.spark_params(mdl.param_sets(), 100) == {
        "stepSize": 0.1, "maxDepth": 6, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.9", "minInfoGain": 0.016, "minInstancesPerNode": 1}


def test_fit_mixture_and_class_weights(spark):
    from sigbg.sources.fixtures import evt
    e = evt(spark, SF_SMALL)
    w, mu, sd = mdl.fit_mixture(e, "value", k=2)
    assert len(w) == len(mu) == len(sd) == 2 and abs(sum(w) - 1.0) < 1e-6 and min(sd) > 0
    cw = mdl.class_weights(e).groupBy("labels").agg(F.first("weight").alias("w"), F.count(F.lit(1)).alias("n")) \
        .toPandas().set_index("labels")
    assert cw.loc[0, "w"] == 1.0
    assert abs(cw.loc[1, "w"] - cw.loc[0, "n"] / cw.loc[1, "n"]) < 1e-12


def test_svc_grid_scores_all_machines_at_once(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import vector_to_array
    from sigbg.operators import sample as smp
    calls = []
    monkeypatch.setattr(mdl, "exact_auc", lambda *a, **k: calls.append(1) or curves.auc(*a, **k))
    v = mdl.with_vector(spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)], int(i % 7 + i % 3 > 4)) for i in range(90)],
                                              "k long, features array<double>, labels int"))
    got = {r["C"]: r["mean_auc"] for r in mdl.grid_search_svc(spark, v, "k", (0.1, 10.0), n_splits=2, max_iter=5).collect()}
    assert len(calls) == 1 and set(got) == {0.1, 10.0}
    s, aucs = smp.stratified_splits(v, "labels", "k", 2, 0.25, 28), []
    for i in range(2):
        train = s.filter((F.col("repeat") == i) & (F.col("is_test") == 0))
        m = LinearSVC(featuresCol="fvec", labelCol="labels", regParam=1.0 / (10.0 * train.count()), maxIter=5).fit(train)
        t = m.transform(s.filter((F.col("repeat") == i) & (F.col("is_test") == 1)))
        aucs.append(curves.auc(t.withColumn("score", vector_to_array("rawPrediction").getItem(1))).first()["auc"])
    assert abs(got[10.0] - sum(aucs) / 2) < 1e-9
