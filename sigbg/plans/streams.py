"""Structured Streaming studies: incremental ingest, running metrics, stream scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import guarded_logit
from ..operators import models as mdl
from ..session import scratch_path
from ..sources.fixtures import EVT_SQL, evt_view, vec, with_views
from ..streaming import stream as st
from ..streaming import windows as win
from .registry import register

EVT = with_views(EVT_SQL)


def _events_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return st.file_stream(spark, f"{sf}/events*.parquet", schema)


LATE_FILES = 6


def _late_stream(spark, sf):
    """The events as several files, newest events first, a sixth of the files a micro-batch."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    path = scratch_path(spark, "late-events")
    span = ev.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"),
                  F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b")).first()
    width = max(1, (span["b"] - span["a"]) // LATE_FILES + 1)
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(span["a"])) / F.lit(width))
    for i in reversed(range(LATE_FILES)):
        ev.filter(part == i).write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return st.file_stream(spark, path, ev.schema, max_files_per_trigger=max(1, files // LATE_FILES))


@register("t1_stream_ingest", "SELECT event_id, event_type, value FROM events")
def t1_stream_ingest(spark, sf):
    out, ck = st.fresh_paths(spark, "t1-ingest")
    st.ingest(_events_stream(spark, sf), out, ck)
    return spark.read.parquet(out).select("event_id", "event_type", "value")


T2_SQL = EVT + """,
s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, LEAST(CAST(floor(score * 1000.0) AS INTEGER), 999) AS bin,
             SUM(labels) AS tp_b, SUM(1 - labels) AS fp_b,
             SUM(CAST(CAST(score > 0.5 AS INTEGER) = labels AS BIGINT)) AS correct
      FROM evt GROUP BY ALL),
c AS (SELECT *, SUM(tp_b) OVER (PARTITION BY day ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS tp FROM s)
SELECT day, CAST(SUM(tp_b) + SUM(fp_b) AS BIGINT) AS n, round(SUM(correct) / (SUM(tp_b) + SUM(fp_b)), 9) AS accuracy,
       round(SUM(fp_b * (tp - tp_b / 2.0)) / (SUM(tp_b) * SUM(fp_b)), 9) AS auc_binned
FROM c GROUP BY day"""


@register("t2_stream_metrics", T2_SQL)
def t2_stream_metrics(spark, sf):
    out, ck = st.fresh_paths(spark, "t2-metrics")
    state = st.run_update(st.windowed_confusion(evt_view(_events_stream(spark, sf))), ["day", "bin"], out, ck)
    return st.metrics_from_state(state)


@register("t2_stream_metrics_late", T2_SQL)
def t2_stream_metrics_late(spark, sf):
    """T2 over several micro-batches in reverse time order: nothing is lost."""
    out, ck = st.fresh_paths(spark, "t2-late")
    state = st.run_update(st.windowed_confusion(evt_view(_late_stream(spark, sf))), ["day", "bin"], out, ck)
    return st.metrics_from_state(state)


T3_SQL = EVT + """
SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n,
       round(corr(ln(score / (1.0 - score + 1e-8) + 1e-8), mbc), 6) AS r
FROM evt GROUP BY 1"""


@register("t3_stream_pearson", T3_SQL)
def t3_stream_pearson(spark, sf):
    out, ck = st.fresh_paths(spark, "t3-pearson")
    state = st.run_update(st.windowed_pearson(evt_view(_events_stream(spark, sf)), "mbc"), ["day"], out, ck)
    return state.select("day", "n", F.round("r", 6).alias("r"))


@register("t3_stream_pearson_late", T3_SQL)
def t3_stream_pearson_late(spark, sf):
    """T3 over several micro-batches in reverse time order."""
    out, ck = st.fresh_paths(spark, "t3-late")
    state = st.run_update(st.windowed_pearson(evt_view(_late_stream(spark, sf)), "mbc"), ["day"], out, ck)
    return state.select("day", "n", F.round("r", 6).alias("r"))


# Events come five days a micro-batch; each fortieth comes a batch late.  A window is closed by the latest event of earlier batches.
DAYS = 5
CLOSING_SQL = EVT.rstrip() + f""",
d AS (SELECT *, date_diff('day', (SELECT min(ts)::DATE FROM evt), ts::DATE) AS day_no FROM evt),
b AS (SELECT *, day_no // {DAYS} + CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END AS batch FROM d),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM b GROUP BY batch),
l AS (SELECT b.*, m.mark IS NOT NULL AND ts::DATE + INTERVAL 1 DAY <= mark AS late FROM b JOIN m USING (batch))"""


def _daily_stream(spark, sf):
    """The events as one file a batch: those of DAYS days, and those of the batch before that come late."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    path = scratch_path(spark, "daily-events")
    first = ev.agg(F.min(F.to_date("ts"))).first()[0]
    no = F.floor(F.date_diff(F.to_date("ts"), F.lit(first)) / DAYS).cast("int") + F.when(F.col("event_id") % 40 == 0, 1).otherwise(0)
    numbered = ev.withColumn("batch", no).persist()
    for i in [r["batch"] for r in numbered.select("batch").distinct().orderBy("batch").collect()]:
        numbered.filter(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(path)
    numbered.unpersist()
    return st.file_stream(spark, path, ev.schema, max_files_per_trigger=1)


@register("t2_stream_reset", CLOSING_SQL + """
SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(COUNT(*) FILTER (WHERE NOT late) AS BIGINT) AS n,
       round(avg(CAST(CAST(score > 0.5 AS INTEGER) = labels AS DOUBLE)) FILTER (WHERE NOT late), 9) AS accuracy,
       round(corr(ln(score / (1.0 - score + 1e-8) + 1e-8), mbc) FILTER (WHERE NOT late), 6) AS r,
       CAST(COUNT(*) FILTER (WHERE late) AS BIGINT) AS n_late
FROM l GROUP BY 1""")
def t2_stream_reset(spark, sf):
    """T2/T3 with closing windows: accuracy and Pearson of each day, reset when it closes, late events counted apart."""
    out, ck = st.fresh_paths(spark, "t2-reset")
    right = ((F.col("score") > 0.5).cast("int") == F.col("labels")).cast("long")
    sums = win.pearson_sums(guarded_logit("score"), F.col("mbc")) | {"rows": F.lit(1).cast("long"), "correct": right}
    store = win.WindowStore(spark, out, [], sums)
    store.run(evt_view(_daily_stream(spark, sf)), ck)
    day = F.date_format(F.timestamp_micros("win"), "yyyy-MM-dd").alias("day")
    got = store.results().select("win", F.col("rows").alias("n"), F.round(F.col("correct") / F.col("rows"), 9).alias("accuracy"), F.round(win.pearson(), 6).alias("r"))
    return got.join(store.late().withColumnRenamed("n", "n_late"), "win", "left").select(day, "n", "accuracy", "r", F.coalesce("n_late", F.lit(0)).cast("long").alias("n_late"))


@register("t4_stream_scoring", "SELECT vec_id, TRUE AS is_probability FROM embeddings")
def t4_stream_scoring(spark, sf):
    v = mdl.with_vector(vec(spark, sf).withColumnRenamed("embedding", "features"))
    model = mdl.gbt({"maxIter": 10, "maxDepth": 3}).fit(v)
    schema = spark.read.parquet(f"{sf}/embeddings.parquet").schema
    s = st.file_stream(spark, f"{sf}/embeddings*.parquet", schema)
    s = mdl.with_vector(s.withColumnRenamed("embedding", "features"))
    out, ck = st.fresh_paths(spark, "t4-score")
    st.score_stream(model, s, out, ck, keep=["vec_id"])
    return spark.read.parquet(out).select("vec_id", F.col("score").between(0.0, 1.0).alias("is_probability"))
