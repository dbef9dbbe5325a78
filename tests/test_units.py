"""Boundary rules and properties on small hand-made frames."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigbg.functions import scalar as sc
from sigbg.operators import curves, hist, nested, prefix, sample, working_point
from sigbg.sources import shards


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_prefix_running_equals_single_window(spark):
    rnd = random.Random(7)
    rows = [(i % 3, rnd.randint(0, 50), rnd.random()) for i in range(400)]
    df = _df(spark, rows, "g int, k int, v double").withColumn("id", F.monotonically_increasing_id())
    got = prefix.running(df, order=["k", "id"], values={"cs": "v"}, block=(F.col("k") / 10).cast("int"),
                         partition_by=["g"]).select("id", "cs").toPandas().set_index("id")["cs"]
    w = Window.partitionBy("g").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("id", F.sum("v").over(w).alias("cs")).toPandas().set_index("id")["cs"]
    assert (got.sort_index() - exp.sort_index()).abs().max() < 1e-9


def test_prefix_descending_and_max(spark):
    df = _df(spark, [(i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6])], "i int, v double")
    r = prefix.running(df, order=["i"], values={"m": "v"}, block=(F.col("i") / 3).cast("int"),
                       how="max").orderBy("i").toPandas()
    assert list(r["m"]) == [3, 3, 4, 4, 5, 9, 9, 9]
    d = prefix.row_number(df, order=["i"], block=(F.col("i") / 3).cast("int"), descending=True) \
              .orderBy("i").toPandas()
    assert list(d["rn"]) == [8, 7, 6, 5, 4, 3, 2, 1]


def test_histogram_last_bin_closed_and_total(spark):
    df = _df(spark, [(float(x),) for x in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    h = hist.histogram(df, "x", 5).orderBy("bin").toPandas()
    assert list(h["n"]) == [2, 2, 2, 2, 3]            # 10 goes into the last bin
    assert h["n"].sum() == 11
    assert abs(h["frac"].sum() - 1.0) < 1e-8      # fractions are rounded to 9 places


def test_histogram_constant_column(spark):
    df = _df(spark, [(2.0,)] * 5, "x double")
    h = hist.histogram(df, "x", 4).toPandas()
    assert h["n"].sum() == 5 and len(h) == 4


def test_truncate_tails_sequential(spark):
    vals = [0.0] * 50 + [1.0] * 50 + [100.0]
    df = _df(spark, [(v,) for v in vals], "x double")
    out = hist.truncate_tails(df, "x", nsigma=3.0).toPandas()
    assert 100.0 not in set(out["x"]) and len(out) == 100


def test_roc_monotone_and_auc_symmetry(spark):
    rnd = random.Random(3)
    rows = [(int(rnd.random() < 0.4), round(rnd.random(), 2)) for _ in range(300)]
    df = _df(spark, rows, "labels int, score double")
    roc = curves.roc_curve(df).toPandas().sort_values(["tp", "fp"])
    assert roc["tpr"].is_monotonic_increasing and roc["fpr"].is_monotonic_increasing
    assert roc["tpr"].iloc[0] == 0 and roc["tpr"].iloc[-1] == 1 and roc["fpr"].iloc[-1] == 1
    a = curves.auc(df).first()["auc"]
    b = curves.auc(df.withColumn("score", 1.0 - F.col("score"))).first()["auc"]
    assert abs(a + b - 1.0) < 1e-9
    # brute force pair statistic
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    bf = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(a - bf) < 1e-9


def test_auc_does_not_depend_on_blocks_or_scale(spark):
    rows = [(int(i % 3 == 0), float(i * 37 % 200) * 3.5 - 100.0) for i in range(200)]
    df = _df(spark, rows, "labels int, score double")
    a = curves.auc(df).first()["auc"]
    b = curves.auc(df, rows_per_block=3).first()["auc"]
    c = curves.auc(df.withColumn("score", F.col("score") * 1e-14 + 0.5), rows_per_block=7).first()["auc"]
    assert abs(a - b) < 1e-12 and abs(a - c) < 1e-12


def test_scores_apart_by_a_hair(spark):
    df = _df(spark, [(i, 0, 0.5 + i * 1e-11) for i in range(100)] + [(1000 + i, 1, 0.5 + (200 + i) * 1e-11) for i in range(50)],
             "id int, labels int, score double")
    assert curves.auc(df).first()["auc"] == 1.0
    post, thr = working_point.rejection_working_point(df, "id", rejection=0.9)      # int(100 * (1 - 0.9)) is 9
    assert {r["id"] for r in post.collect()} == set(range(91, 100)) and thr == 0.5 + 91 * 1e-11


def test_working_point_ties_nulls_and_empty(spark):
    df = _df(spark, [(i, 0, 0.9) for i in range(50)] + [(100, 0, None), (101, 0, float("nan"))], "id int, labels int, score double")
    post, thr = working_point.rejection_working_point(df, "id", rejection=0.75)
    assert {r["id"] for r in post.collect()} == set(range(13)) and thr == 0.9
    post, thr = working_point.rejection_working_point(df.limit(0), "id")
    assert post.count() == 0 and thr is None
    assert working_point.quantile_bins(df.limit(0), "score", 4, "b").count() == 0
    assert curves.roc_curve(df.limit(0)).count() == 0


def _grouped(spark):
    rows = [(i, None if i % 5 == 0 else i % 2, None if i % 5 == 1 else "ab"[i % 2], float(i % 17)) for i in range(1000)]
    return _df(spark, rows, "k int, labels int, channel string, x double")


def test_null_groups_are_groups(spark):
    df = _grouped(spark)
    assert hist.histogram(df, "x", 10, by=["channel"], shared=False).agg(F.sum("n")).first()[0] == 1000
    assert hist.histogram(df, "x", 10, by=["channel"], shared=True).agg(F.sum("n")).first()[0] == 1000
    assert hist.truncate_tails(df, "x", 5.0, by=["channel"]).count() == 1000
    assert hist.efficiency(df, "x", F.col("x") > 3, 5, by=["labels"]).agg(F.sum("n_before")).first()[0] == 1000
    ranks = sample.ranked(df, 1, "k", partition_by=["labels"]).groupBy("labels").agg(F.max("rn").alias("m")).collect()
    assert {r["labels"]: r["m"] for r in ranks} == {None: 200, 0: 400, 1: 400}
    sizes = {r["labels"]: r["count"] for r in sample.undersample(df, "labels", 3, "k").groupBy("labels").count().collect()}
    assert sizes == {None: 200, 0: 200, 1: 200}
    over = {r["labels"]: r["count"] for r in sample.oversample(df, "labels", 3, "k").groupBy("labels").count().collect()}
    assert over == {None: 400, 0: 400, 1: 400}
    left = sample.drop_fraction(df, "labels", 1, 0.25, 3, "k").groupBy("labels").count().collect()
    assert {r["labels"]: r["count"] for r in left} == {None: 200, 0: 400, 1: 300}
    split = sample.stratified_splits(df, "labels", "k", 2, 0.25).filter("is_test = 1").groupBy("repeat", "labels").count().collect()
    assert {(r["repeat"], r["labels"]): r["count"] for r in split} == {(i, c): n for i in (0, 1) for c, n in ((None, 50), (0, 100), (1, 100))}
    roc = curves.roc_curve(df.withColumn("labels", (F.col("k") % 2)).withColumn("score", F.col("x")), by=["channel"])
    assert {r["channel"] for r in roc.collect()} == {None, "a", "b"}
    from sigbg.operators import metrics
    e = metrics.epoch_losses(df.select(F.col("labels").alias("epoch"), F.col("k").alias("step"), F.col("x").alias("loss")))
    assert e.count() == 1000


def test_hash_order_selection_equals_full_ranking(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("k"))
    want = {r["k"] for r in sample.ranked(df, 9, "k").filter("rn > 100 AND rn <= 750").collect()}
    assert {r["k"] for r in sample.positional_slice(df, 9, "k", 100, 750).collect()} == want
    assert sample.positional_slice(df, 9, "k", 0, 9000).count() == 5000
    assert sample.exact_split(df.limit(0), 0.5, 1, "k").count() == 0


def test_exact_n_sampling_and_repartition_invariance(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("labels"))
    u = sample.undersample(df, "labels", 42, "k")
    c = {r["labels"]: r["count"] for r in u.groupBy("labels").count().collect()}
    assert c[0] == c[1] == 334
    a = {r["k"] for r in sample.exact_split(df, 0.1, 42, "k").filter("is_test = 1").collect()}
    b = {r["k"] for r in sample.exact_split(df.repartition(7), 0.1, 42, "k").filter("is_test = 1").collect()}
    assert a == b and len(a) == 100


def test_batches_cover_each_row_once(spark):
    df = spark.range(0, 103).select(F.col("id").alias("k"))
    b = sample.batches(df, "k", 10, epochs=2).toPandas()
    for e in (0, 1):
        part = b[b["epoch"] == e]
        assert sorted(part["k"]) == list(range(103))
        assert part.groupby("step").size().max() == 10 and part["step"].max() == 10   # tail kept


def test_oversample_sizes(spark):
    df = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") < 10).cast("int").alias("labels"))
    o = sample.oversample(df, "labels", 42, "k")
    c = {r["labels"]: r["count"] for r in o.groupBy("labels").count().collect()}
    assert c[0] == c[1] == 40


def test_quantile_bins_and_duplicate_edges(spark):
    df = _df(spark, [(float(i),) for i in range(1, 101)], "x double")
    b = working_point.quantile_bins(df, "x", 10, "b").groupBy("b").count().toPandas()
    assert sorted(b["count"]) == [10] * 10
    dup = _df(spark, [(1.0,)] * 50 + [(2.0,)] * 50, "x double")
    with pytest.raises(Exception):
        working_point.quantile_bins(dup, "x", 10, "b").collect()


def test_working_point_keeps_exact_k(spark):
    rows = [(i, 0, round((i % 7) / 10, 1)) for i in range(100)] + [(1000 + i, 1, 0.5) for i in range(10)]
    df = _df(spark, rows, "id int, labels int, score double")
    post, thr = working_point.rejection_working_point(df, "id", rejection=0.95)
    assert post.count() == 5
    assert post.agg(F.min("score")).first()[0] == pytest.approx(0.6)


def test_scalar_functions(spark):
    df = _df(spark, [([1.0, 3.0, 2.0], 0.0), ([5.0, 5.0], 1.0), ([0.0], 0.5)], "a array<double>, p double")
    r = df.select(sc.argmax("a").alias("am"), sc.log_sum_exp("a").alias("lse"),
                  F.aggregate(sc.softmax("a"), F.lit(0.0), lambda x, y: x + y).alias("ss"),
                  sc.logit("p").alias("lg")).collect()
    assert [x["am"] for x in r] == [1, 0, 0]
    assert r[0]["lse"] == pytest.approx(math.log(math.exp(1) + math.exp(3) + math.exp(2)))
    assert all(x["ss"] == pytest.approx(1.0) for x in r)
    assert r[0]["lg"] == float("-inf") and r[1]["lg"] == float("inf") and r[2]["lg"] == 0.0


def test_reshape_requires_divisible(spark):
    df = _df(spark, [([1.0, 2.0, 3.0],)], "a array<double>")
    with pytest.raises(Exception):
        df.select(nested.reshape("a", 2)).collect()
    ok = _df(spark, [([1.0, 2.0, 3.0, 4.0],)], "a array<double>").select(nested.reshape("a", 2).alias("r")).first()
    assert ok["r"] == [[1.0, 2.0], [3.0, 4.0]]


def test_object_pairs(spark):
    df = _df(spark, [([[1.0], [2.0], [3.0]],)], "o array<array<double>>")
    r = df.select(nested.object_pairs("o").alias("p")).first()["p"]
    assert len(r) == 6 and [1.0, 2.0] in r and [1.0, 1.0] not in r


def test_tfrecord_codec_roundtrip():
    ex = {"features": [0.5, -1.25, 3.0], "labels": [1.0]}
    back = shards.decode_example(shards.encode_example(ex))
    assert back == ex
    # published CRC-32C check value
    assert shards.crc32c(b"123456789") == 0xE3069283


def test_scaling_moments(spark):
    from sigbg.operators import scale
    rnd = random.Random(5)
    df = _df(spark, [(rnd.gauss(3, 2), rnd.random() * 10) for _ in range(300)], "a double, b double")
    s = scale.standardise_pop(df, ["a", "b"]).agg(F.avg("a"), F.stddev_pop("a"), F.avg("b"), F.stddev_pop("b")).first()
    assert abs(s[0]) < 1e-9 and abs(s[1] - 1) < 1e-9 and abs(s[2]) < 1e-9 and abs(s[3] - 1) < 1e-9
    m = scale.centre_maxabs(df, ["a"]).agg(F.max(F.abs("a")), F.avg("a")).first()
    assert abs(m[0] - 1) < 1e-12 and abs(m[1]) < 1e-9


def test_efficiency_bounds_and_null_bins(spark):
    rnd = random.Random(9)
    rows = [(int(rnd.random() < 0.5), rnd.random() * 100, rnd.random()) for _ in range(400)]
    df = _df(spark, rows, "labels int, x double, score double")
    e = hist.efficiency(df, "x", F.col("score") < 0.5, 20).toPandas()
    ok = e.dropna(subset=["eff"])
    assert ((ok["eff"] >= 0) & (ok["eff"] <= 1)).all()
    assert (e[e["n_before"] == 0]["eff"].isna()).all()


def test_decision_is_strict(spark):
    df = _df(spark, [(0.5,), (0.5000001,), (0.4999999,)], "s double")
    assert [r[0] for r in df.select(sc.decision("s", 0.5)).collect()] == [0, 1, 0]


def test_nan_and_null_handling(spark):
    from sigbg.operators import select as sel
    df = _df(spark, [(1.0, 2.0), (2.0, 4.1), (float("nan"), 1.0), (None, 3.0), (4.0, 8.2)], "a double, b double")
    assert sel.drop_missing(df).count() == 3
    r = sel.pearson(df, "a", "b").first()["r"]          # NaN treated as missing, pairwise
    assert r is not None and r == r and r > 0.99


def test_single_class_auc_is_null(spark):
    df = _df(spark, [(1, 0.3), (1, 0.7)], "labels int, score double")
    r = curves.auc(df).first()
    assert r["n_neg"] == 0 and r["auc"] is None


def test_oversample_extreme_imbalance(spark):
    df = spark.range(0, 201).select(F.col("id").alias("k"), (F.col("id") == 0).cast("int").alias("labels"))
    o = sample.oversample(df, "labels", 7, "k")
    c = {r["labels"]: r["count"] for r in o.groupBy("labels").count().collect()}
    assert c[0] == c[1] == 200
    assert {r["k"] for r in o.filter("labels = 1").collect()} == {0}
    assert o.filter("labels = 0").select("draw").distinct().count() == 200


def test_correlations_with_missing_values_at_any_width(spark):
    import numpy as np
    import pandas as pd
    from sigbg.operators import select as sel
    rng = np.random.default_rng(2)
    for d in (4, 41, 60):
        x = rng.normal(1e6, 1.0, (300, d)) + rng.normal(0, 1, (300, 1))
        x[np.arange(300), np.arange(300) % d] = np.nan            # every row misses a value
        pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(d)])
        pdf["flat"] = 3.0
        want = pdf.corr()
        rows = [tuple(None if i % 2 and v != v else float(v) for i, v in enumerate(r)) for r in pdf.to_numpy()]
        df = _df(spark, rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(3)
        got = {(r["a"], r["b"]): r["r"] for r in sel.corr_long(df, list(pdf.columns)).collect()}
        assert len(got) == d * (d + 1) // 2
        assert all(got[(f"c{i}", "flat")] is None for i in range(d))
        assert all(abs(got[(f"c{i}", f"c{j}")] - want.iloc[i, j]) < 1e-9 for i in range(d) for j in range(i + 1, d))
    empty = sel.corr_long(df.limit(0), list(pdf.columns))
    assert all(r["r"] is None for r in empty.collect())


def test_near_duplicates_looks_at_every_pair(spark):
    from sigbg.operators import select as sel
    rows = [(f"a{i:03d}", f"b{i:03d}", i, 500 + i, 0.999999) for i in range(300)]
    long = _df(spark, rows, "a string, b string, a_pos int, b_pos int, r double")
    assert sel.near_duplicates(long).count() == 300



def test_shard_matrix_and_single_records_agree():
    import numpy as np
    from sigbg.sources import shards
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 7)).astype("float32"), rng.normal(size=50).astype("float32")
    y[3] = x[2, 1] = 0.0
    assert shards.crc32c_rows(np.frombuffer(b"123456789" * 3, np.uint8).reshape(3, 9)).tolist() == [0xE3069283] * 3
    for labels in (y, None):
        raw = shards.encode_rows(x, labels)
        single = b"".join(shards._frame(np.frombuffer(shards.encode_example(
            {"features": r.tolist()} | ({} if labels is None else {"labels": [float(labels[i])]})), np.uint8)[None, :]) for i, r in enumerate(x))
        assert raw == single
        got = shards.decode_file(raw)
        assert np.allclose(np.array(got.column(0).to_pylist()), x) and got.column(1).null_count == (0 if labels is not None else 50)
    assert len(shards.decode_file(b"")) == 0


def test_shard_failures_are_loud(spark, tmp_path):
    import numpy as np
    from sigbg.sources import shards
    raw = shards.encode_rows(np.ones((3, 2), "float32"), np.ones(3, "float32"))
    for broken in (raw[:-1], raw[:len(raw) // 3 + 5], raw[:20] + b"x" + raw[21:], raw + b"abc"):
        with pytest.raises(ValueError):
            shards.decode_file(broken)
    entry = shards._field(1, b"labels") + shards._field(2, shards._field(3, shards._field(1, shards._varint(1))))
    feats = shards._field(1, b"features") + shards._field(2, shards._float_feature([1.0, 2.0]))
    whole = shards._field(1, shards._field(1, entry) + shards._field(1, feats))
    got = shards.decode_file(shards._frame(np.frombuffer(whole, np.uint8)[None, :]))
    assert got.column(0).to_pylist() == [[1.0, 2.0]] and got.column(1).to_pylist() == [1.0]      # an integer label
    text = shards._field(1, shards._field(1, shards._field(1, b"labels") + shards._field(2, shards._field(1, shards._field(1, b"one")))))
    with pytest.raises(ValueError):
        shards.decode_file(shards._frame(np.frombuffer(text, np.uint8)[None, :]))
    path = str(tmp_path / "s")
    df = _df(spark, [([1.0, 2.0], 1), ([3.0, 4.0], None), ([5.0, 6.0], 0)], "features array<double>, labels int")
    for _ in range(2):
        shards.write_shards(df, path, mode="overwrite", records_per_file=2)
    assert sorted((r.features[0], r.labels) for r in shards.read_shards(spark, path, 2, "int").collect()) == [(1.0, 1), (3.0, 0), (5.0, 0)]
    shards.write_shards(df, path)
    assert shards.read_shards(spark, path, 2).count() == 6
    with pytest.raises(Exception, match="not 3 features"):
        shards.read_shards(spark, path, 3).collect()
    with pytest.raises(Exception, match="mounted filesystem"):
        shards.write_shards(df, "hdfs://host/x")


def test_char_codes_by_code_point(spark):
    from sigbg.operators import nested
    texts = [(1, "abba\n\0"), (2, "\U0001F600é a"), (3, ""), (4, None), (5, "zz" * 50), (6, "￿\U00010000")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    dic = nested.char_dictionary(df)
    want = sorted({c for _, t in texts for c in t or ""})
    assert [(r.ch, r.ix, r.n) for r in dic.orderBy("ix").collect()] == [(c, i, sum((t or "").count(c) for _, t in texts)) for i, c in enumerate(want)]
    enc = nested.decode_text(nested.encode_text(df, dic), dic, out="back")
    for r in enc.collect():
        assert r.codes == (None if r.text is None else [want.index(c) for c in r.text]) and r.back == r.text
    part = dic.filter("ch IN ('a', 'z')")                                 # a character without an index: null, and nothing on the way back
    got = {r.id: (r.codes, r.back) for r in nested.decode_text(nested.encode_text(df, part), part, out="back").collect()}
    assert got[1] == ([want.index("a"), None, None, want.index("a"), None, None], "aa") and got[3] == ([], "") and got[4] == (None, None)
    empty = dic.limit(0)
    assert {(None if r.codes is None else tuple(r.codes), r.back) for r in nested.decode_text(nested.encode_text(df.filter("id = 5 OR id IS NULL"), empty), empty, out="back").collect()} == {((None,) * 100, "")}
    # No row a character, and no walk through the alphabet for each of them.
    assert "Generate" not in dic._jdf.queryExecution().executedPlan().toString()
    assert "element_at" not in enc._jdf.queryExecution().executedPlan().toString()
