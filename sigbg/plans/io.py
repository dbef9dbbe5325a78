"""Source / sink studies: scans, conversion, shards, stores, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, sql_hash_bucket
from ..operators import curves, metrics, scale
from ..operators import models as mdl
from ..operators import select as sel
from ..operators.select import Roles, role_split
from ..session import scratch_path
from ..sources import io, shards
from ..sources.fixtures import CAND_D_COEF, CAND_Q_COEF, CAND_SQL, EVT_SQL, VEC_SQL, cand, evt, vec, with_views
from ..sources.tables import read_all, read_head, read_pruned, read_table
from .registry import register

CAND = with_views(CAND_SQL)
EVT = with_views(EVT_SQL)
VEC = with_views(VEC_SQL)


@register("s1_s3_column_scan", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 45")
def s1_s3_column_scan(spark, sf):
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_quantity", "l_returnflag"])
    return li.filter(F.col("l_quantity") > 45)


@register("s2_pruned_scan", "SELECT o_orderstatus, o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def s2_pruned_scan(spark, sf):
    return read_pruned(spark, sf, "orders", ["key", "price", "date"], first="o_orderstatus")


_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
         "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
         "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}


@register("s2_all_tables", "\nUNION ALL ".join(f"SELECT '{t}' AS \"table\", COUNT(*) AS n, CAST(SUM({k}) AS BIGINT) AS key_sum FROM {t}"
                                               for t, k in _KEYS.items()))
def s2_all_tables(spark, sf):
    """Every table by name."""
    out = None
    for t, df in read_all(spark, sf).items():
        row = df.agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("n"), F.sum(F.col(_KEYS[t]).cast("bigint")).alias("key_sum"))
        out = row if out is None else out.unionByName(row)
    return out


@register("s4_head_rows", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 25000")
def s4_head_rows(spark, sf):
    return read_head(read_table(spark, sf, "events", ["event_id", "event_type", "value"]), 25_000, ["event_id"])


@register("s5_s6_pinned_convert", "SELECT event_id, user_id, event_type, value, props FROM events")
def s5_s6_pinned_convert(spark, sf):
    out = scratch_path(spark, "s5-convert")
    df = io.convert(spark, f"{sf}/events.parquet", out)
    return df.select("event_id", "user_id", "event_type", "value", "props")


@register("s7_s8_shard_roundtrip", VEC + """
SELECT CAST(embedding AS FLOAT[]) AS features, labels FROM vec""")
def s7_s8_shard_roundtrip(spark, sf):
    """Integer labels go in, are stored as floats and come out as integers again."""
    v = vec(spark, sf).select(F.col("embedding").alias("features"), "labels")
    path = scratch_path(spark, "s7-shards")
    shards.write_shards(v, path)
    return shards.read_shards(spark, path, 64, label_type="int")


@register("s9_prepared_cache", CAND + """
SELECT labels, CAST(mbc AS FLOAT) AS mbc, CAST(deltae AS FLOAT) AS deltae,
       [CAST(l_quantity AS FLOAT), CAST(l_discount AS FLOAT), CAST(l_tax AS FLOAT)] AS features FROM cand""")
def s9_prepared_cache(spark, sf):
    c = cand(spark, sf)
    prep = role_split(c, Roles(), features=["l_quantity", "l_discount", "l_tax"])
    return io.materialise(prep, scratch_path(spark, "s9-cache"))


@register("s10_named_store", EVT + """
SELECT event_id, value, CASE WHEN labels = 1 THEN 'sig' ELSE 'bkg' END AS dataset FROM evt""")
def s10_named_store(spark, sf):
    e = evt(spark, sf).select("event_id", "value", "labels")
    path = scratch_path(spark, "s10-store")
    io.store_frames({"sig": e.filter("labels = 1").drop("labels"), "bkg": e.filter("labels = 0").drop("labels")},
                    path)
    both = [io.load_frame(spark, path, name).select("event_id", "value", "dataset") for name in ("sig", "bkg")]
    return both[0].unionByName(both[1])


@register("s11_prediction_sink", VEC + "SELECT vec_id, labels, TRUE AS is_probability FROM vec")
def s11_prediction_sink(spark, sf):
    v = mdl.with_vector(vec(spark, sf).withColumnRenamed("embedding", "features"))
    m = mdl.gbt({"maxIter": 10, "maxDepth": 3}).fit(v)
    scored = mdl.score(m, v).select("vec_id", "labels", "score")
    out = io.write_predictions(scored, scratch_path(spark, "s11-pred"))
    return out.select("vec_id", "labels", F.col("score").between(0.0, 1.0).alias("is_probability"))


@register("s12_run_registry", CAND + """,
c AS (SELECT channel, score, SUM(labels)::BIGINT AS tp_s, SUM(1 - labels)::BIGINT AS fp_s FROM cand GROUP BY ALL),
r AS (SELECT channel, tp_s, fp_s,
             SUM(tp_s) OVER (PARTITION BY channel ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM c)
SELECT channel AS run, channel, 'fixed' AS mode, 'formula' AS arch, CAST(1 AS BIGINT) AS layers, CAST(SUM(tp_s) + SUM(fp_s) AS BIGINT) AS batch_size,
       CAST(0.0 AS DOUBLE) AS dropout, CAST(1 AS BIGINT) AS epochs, CAST(NULL AS DOUBLE) AS time, CAST(NULL AS VARCHAR) AS timestamp,
       CAST(NULL AS DOUBLE) AS train_acc,
       (SELECT round(AVG(CAST(CAST(score > 0.5 AS INTEGER) = labels AS DOUBLE)), 9) FROM cand c2 WHERE c2.channel = r.channel) AS test_acc,
       round(SUM(fp_s * (tp - tp_s / 2.0)) / (CAST(SUM(tp_s) AS DOUBLE) * SUM(fp_s)), 9) AS test_auc,
       '0.05' AS q_coef, '-20.0' AS d_coef
FROM r GROUP BY channel""")
def s12_run_registry(spark, sf):
    """All fields of the run record, read back with the parameters."""
    c = cand(spark, sf)
    a = curves.auc(c, by=["channel"]).withColumn("auc", F.round("auc", 9))
    acc = metrics.score_metrics(c, by=["channel"]).select(F.col("channel").alias("ch"), "accuracy")
    rec = a.join(acc, F.col("channel") == F.col("ch")).select(
        F.col("channel").alias("run"), "channel", F.lit("fixed").alias("mode"), F.lit("formula").alias("arch"), F.lit(1).alias("layers"),
        (F.col("n_pos") + F.col("n_neg")).alias("batch_size"), F.lit(0.0).alias("dropout"), F.lit(1).alias("epochs"),
        F.col("accuracy").alias("test_acc"), F.col("auc").alias("test_auc"),
        F.create_map(F.lit("q_coef"), F.lit(str(CAND_Q_COEF)), F.lit("d_coef"), F.lit(str(CAND_D_COEF))).alias("params"))
    path = scratch_path(spark, "s12-runs")
    io.append_runs(rec, path)
    out = io.read_runs(spark, path)
    return out.select(*[x for x in out.columns if x != "params"], F.col("params")["q_coef"].alias("q_coef"), F.col("params")["d_coef"].alias("d_coef"))


_SEARCH_Q = ("0.02", "0.05", "0.1")


@register("s12_search_registry", CAND + f""",
p AS (SELECT * FROM (VALUES {', '.join(f"({i}::BIGINT, '{q}')" for i, q in enumerate(_SEARCH_Q))}) p(counter, q)),
m AS (SELECT counter, q, labels, CAST(q AS DOUBLE) * l_quantity - 20.0::DOUBLE * l_discount AS z FROM cand, p),
c AS (SELECT counter, q, z, SUM(labels)::BIGINT AS tp_s, SUM(1 - labels)::BIGINT AS fp_s FROM m GROUP BY ALL),
r AS (SELECT *, SUM(tp_s) OVER (PARTITION BY counter ORDER BY z DESC ROWS UNBOUNDED PRECEDING) AS tp FROM c),
a AS (SELECT counter, q, round(SUM(fp_s * (tp - tp_s / 2.0)) / (CAST(SUM(tp_s) AS DOUBLE) * SUM(fp_s)), 9) AS auc,
             CAST(CAST(round(SUM(CASE WHEN z > 0 THEN fp_s ELSE tp_s END) / CAST(SUM(tp_s + fp_s) AS DOUBLE), 6) AS DECIMAL(9, 6)) AS VARCHAR) AS error
      FROM r GROUP BY counter, q)
SELECT 'q' || counter AS run, auc, error, CAST(1 AS BIGINT) AS best_iteration, counter, CAST(NULL AS BIGINT) AS seconds, CAST(1.0 AS DOUBLE) AS iterations,
       q, '20.0' AS d, auc = MAX(auc) OVER () AS is_best FROM a""")
def s12_search_registry(spark, sf):
    """A search over the scorer's coefficient: one record a run, appended run by run, read back, the best one marked."""
    c = cand(spark, sf)
    path = scratch_path(spark, "s12-search")
    for i, q in enumerate(_SEARCH_Q):
        z = c.select("labels", (F.lit(float(q)) * F.col("l_quantity") - F.lit(20.0) * F.col("l_discount")).alias("score"))
        wrong = F.avg(((F.col("score") > 0).cast("int") != F.col("labels")).cast("double"))
        error = z.agg(F.round(wrong, 6).cast("decimal(9,6)").cast("string").alias("error"))
        rec = curves.auc(z).select(F.lit(f"q{i}").alias("run"), F.round("auc", 9).alias("auc"), error.scalar().alias("error"),
                                   F.lit(1).alias("best_iteration"), F.lit(i).alias("counter"), F.lit(1.0).alias("iterations"),
                                   F.create_map(F.lit("q"), F.lit(q), F.lit("d"), F.lit("20.0")).alias("params"))
        io.append_runs(rec, path, io.SEARCH_SCHEMA)
    out = io.read_runs(spark, path, io.SEARCH_SCHEMA)
    best = out.agg(F.max("auc")).scalar()
    return out.select(*[x for x in out.columns if x != "params"], F.col("params")["q"].alias("q"), F.col("params")["d"].alias("d"),
                      (F.col("auc") == best).alias("is_best"))


_FEATS = ["l_quantity", "l_discount", "l_tax", "qty_tax"]
_PREP_IS_TEST = f"{sql_hash_bucket(42, 'l_orderkey', 'l_linenumber', 'mbc')} >= 9000"


@register("prep_job", CAND.rstrip() + f""",
f AS (SELECT l_orderkey, l_linenumber, labels, mbc, deltae, l_quantity, l_discount, l_tax, l_quantity * l_tax AS qty_tax,
             CAST({_PREP_IS_TEST} AS INTEGER) AS is_test FROM cand),
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in _FEATS)} FROM f WHERE is_test = 0)
SELECT is_test, labels, COUNT(*) AS n, {', '.join(f'round(SUM(CAST(({c} - m_{c}) / s_{c} AS FLOAT)::DOUBLE), 2) AS sum_{c}' for c in _FEATS)}
FROM f, st GROUP BY is_test, labels""")
def prep_job(spark, sf):
    """The preparation job end to end: prune by name, drop what follows the fit variables, split, scale on the
    training part, write Parquet and training shards, and read both back."""
    key = ["l_orderkey", "l_linenumber"]
    c = cand(spark, sf).drop("score").withColumn("qty_tax", F.col("l_quantity") * F.col("l_tax")) \
        .withColumn("event_weight", F.lit(1.0)).withColumn("row_index", F.col("l_linenumber"))
    c = sel.drop_containing(c)
    roles = sel.Roles(exclude=(*sel.BOOKKEEPING, *key))
    feats = roles.features(c.columns)
    corr = sel.corr_long(c, [*roles.fit_vars, *feats])
    c = sel.apply_drops(c, sel.correlated_to_fit(corr))
    feats = [f for f in feats if f in c.columns]
    c = c.withColumn("is_test", (hash_bucket(42, *key, F.col("mbc")) >= 9000).cast("int"))
    scaled = scale.standardise_fit(c.filter("is_test = 0"), feats)(c)
    out = scratch_path(spark, "prepared")
    scaled.select("is_test", "labels", "mbc", "deltae", F.array(*[F.col(f).cast("float") for f in feats]).alias("features")) \
        .write.mode("overwrite").partitionBy("is_test").parquet(out)
    back = None
    for part in (0, 1):
        path = scratch_path(spark, "prepared-shards")
        shards.write_shards(spark.read.parquet(out).filter(F.col("is_test") == part), path)
        s = shards.read_shards(spark, path, len(feats), "int").withColumn("is_test", F.lit(part))
        back = s if back is None else back.unionByName(s)
    return back.groupBy("is_test", "labels").agg(F.count(F.lit(1)).alias("n"), *[
        F.round(F.sum(F.col("features")[i].cast("double")), 2).alias(f"sum_{f}") for i, f in enumerate(feats)])
