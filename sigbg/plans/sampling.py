"""Sampling, splitting, batching and union/join studies on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_hash_bucket, sql_hash_hex
from ..operators import metrics
from ..operators import sample as smp
from ..sources.fixtures import EVT_SQL, evt, with_views
from ..sources.tables import read_table
from .registry import register

EVT = with_views(EVT_SQL)
H = sql_hash_hex(42, "event_id")


@register("k9_shuffle_rank", EVT + f"""
SELECT event_id, row_number() OVER (ORDER BY {H}, event_id) AS rn FROM evt""")
def k9_shuffle_rank(spark, sf):
    return smp.ranked(evt(spark, sf).select("event_id"), 42, "event_id")


@register("k9_buffer_shuffle", """SELECT COUNT(*) AS n, SUM(event_id)::BIGINT AS ids, TRUE AS whole, TRUE AS within_buffer, TRUE AS mixed FROM events""")
def k9_buffer_shuffle(spark, sf):
    """K9 through a buffer of 500 rows: every place is filled once, no row is more than 500 places early, and the order changes."""
    s = smp.buffer_shuffle(read_table(spark, sf, "events", ["event_id"]), 500)
    per = s.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.countDistinct("place").alias("places"),
                                F.max("place").alias("last"), F.max(F.col("source_place") - F.col("place")).alias("early"),
                                F.sum((F.col("source_place") != F.col("place")).cast("long")).alias("moved"))
    return per.agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.min((F.col("places") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("whole"),
                   (F.max("early") <= 500).alias("within_buffer"), (F.sum("moved") * 2 > F.sum("n")).alias("mixed"))


_BATCH_SQL = EVT.rstrip() + f""",
rep AS (SELECT evt.*, e.epoch FROM evt CROSS JOIN (SELECT CAST(range AS INTEGER) AS epoch FROM range(2)) e),
b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY epoch ORDER BY
            {sql_hash_hex(42, 'epoch', 'event_id')}, event_id) - 1) / 256) AS BIGINT) AS step FROM rep)"""


@register("k10_batches", _BATCH_SQL + "\nSELECT event_id, epoch, step FROM b")
def k10_batches(spark, sf):
    return smp.batches(evt(spark, sf).select("event_id"), "event_id", 256, epochs=2) \
              .select("event_id", F.col("epoch").cast("int").alias("epoch"), "step")


@register("g13_epoch_losses", _BATCH_SQL + """,
l AS (SELECT epoch, step, AVG(-ln(greatest(CASE WHEN labels = 1 THEN score ELSE 1.0 - score END, 1e-15))) AS loss
      FROM b GROUP BY epoch, step)
SELECT epoch, step, round(loss, 9) AS loss,
       round(AVG(loss) OVER (PARTITION BY epoch ORDER BY step ROWS UNBOUNDED PRECEDING), 9) AS running_mean,
       round(AVG(loss) OVER (PARTITION BY epoch), 9) AS epoch_mean
FROM l""")
def g13_epoch_losses(spark, sf):
    b = smp.batches(evt(spark, sf), "event_id", 256, epochs=2)
    losses = b.groupBy(F.col("epoch").cast("int").alias("epoch"), "step") \
              .agg(F.avg(metrics.row_log_loss()).alias("loss"))
    return metrics.epoch_losses(losses)


@register("x1_hash_split", EVT + f"""
SELECT event_id, CASE WHEN {sql_hash_bucket(42, 'event_id')} < 9000 THEN 0 ELSE 1 END AS split FROM evt""")
def x1_hash_split(spark, sf):
    return smp.hash_split(evt(spark, sf).select("event_id"), [0.9, 0.1], 42, "event_id")


@register("x2_exact_split", EVT + f"""
SELECT event_id, CAST(row_number() OVER (ORDER BY {sql_hash_hex(24601, 'event_id')}, event_id)
                      <= ceil(COUNT(*) OVER () * 0.05) AS INTEGER) AS is_test FROM evt""")
def x2_exact_split(spark, sf):
    return smp.exact_split(evt(spark, sf).select("event_id"), 0.05, 24601, "event_id")


@register("x3_undersample", EVT + f""",
r AS (SELECT event_id, labels, row_number() OVER (PARTITION BY labels ORDER BY {H}, event_id) AS rn,
             COUNT(*) OVER (PARTITION BY labels) AS n FROM evt)
SELECT event_id, labels FROM r WHERE rn <= (SELECT MIN(n) FROM r)""")
def x3_undersample(spark, sf):
    return smp.undersample(evt(spark, sf).select("event_id", "labels"), "labels", 42, "event_id")


@register("j2_balanced_sample", EVT + f""",
r AS (SELECT event_id, labels, {H} AS h, row_number() OVER (PARTITION BY labels ORDER BY {H}, event_id) AS rn,
             COUNT(*) OVER (PARTITION BY labels) AS n FROM evt)
SELECT event_id, labels FROM r WHERE rn <= (SELECT MIN(n) FROM r) ORDER BY h, event_id""")
def j2_balanced_sample(spark, sf):
    """A sample of equal size of every class, united and shuffled."""
    return smp.balanced_sample(evt(spark, sf).select("event_id", "labels"), "labels", 42, "event_id")


_X4_PICK = "(('0x' || substr(md5(concat_ws(':', '42', CAST(s.labels AS VARCHAR), CAST(s.draw AS VARCHAR))), 1, 15))" \
           "::BIGINT % s.n) + 1"


@register("x4_oversample", EVT + f""",
r AS (SELECT event_id, labels, row_number() OVER (PARTITION BY labels ORDER BY {H}, event_id) AS rn,
             COUNT(*) OVER (PARTITION BY labels) AS n FROM evt),
m AS (SELECT MAX(n) AS M FROM r),
cls AS (SELECT DISTINCT labels, n FROM r),
s AS (SELECT cls.labels, cls.n, CAST(d.range AS BIGINT) AS draw FROM cls, m, range(m.M) d),
p AS (SELECT s.labels, s.draw, {_X4_PICK} AS rn FROM s)
SELECT p.labels, p.draw, r.event_id FROM p JOIN r ON p.labels = r.labels AND p.rn = r.rn""")
def x4_oversample(spark, sf):
    return smp.oversample(evt(spark, sf).select("event_id", "labels"), "labels", 42, "event_id") \
              .select("labels", "draw", "event_id")


@register("x5_drop_signal_fraction", EVT + f""",
r AS (SELECT event_id, labels, row_number() OVER (ORDER BY {H}, event_id) AS rn,
             COUNT(*) OVER () AS n FROM evt WHERE labels = 1)
SELECT event_id, labels FROM r WHERE rn > round(n * 0.75)
UNION ALL SELECT event_id, labels FROM evt WHERE labels <> 1""")
def x5_drop_signal_fraction(spark, sf):
    return smp.drop_fraction(evt(spark, sf).select("event_id", "labels"), "labels", 1, 0.75, 42, "event_id")


@register("x6_positional_slices", EVT + f""",
r AS (SELECT event_id, row_number() OVER (ORDER BY {H}, event_id) AS rn FROM evt)
SELECT event_id, 'train' AS part FROM r WHERE rn > 0 AND rn <= 3200
UNION ALL SELECT event_id, 'test' AS part FROM r WHERE rn > 6400 AND rn <= 7200""")
def x6_positional_slices(spark, sf):
    e = evt(spark, sf).select("event_id")
    a = smp.positional_slice(e, 42, "event_id", 0, 3200).withColumn("part", F.lit("train"))
    b = smp.positional_slice(e, 42, "event_id", 6400, 7200).withColumn("part", F.lit("test"))
    return a.unionByName(b)


@register("x7_stratified_splits", EVT + f""",
rep AS (SELECT evt.*, CAST(e.range AS INTEGER) AS repeat FROM evt CROSS JOIN range(4) e),
r AS (SELECT event_id, labels, repeat,
             row_number() OVER (PARTITION BY repeat, labels ORDER BY {sql_hash_hex(28, 'repeat', 'event_id')}, event_id)
             AS rn, COUNT(*) OVER (PARTITION BY repeat, labels) AS n FROM rep)
SELECT event_id, labels, repeat, CAST(rn <= round(n * 0.25) AS INTEGER) AS is_test FROM r""")
def x7_stratified_splits(spark, sf):
    s = smp.stratified_splits(evt(spark, sf).select("event_id", "labels"), "labels", "event_id", 4, 0.25, 28)
    return s.select("event_id", "labels", F.col("repeat").cast("int").alias("repeat"), "is_test")


@register("x8_stratified_folds", EVT + f"""
SELECT event_id, labels, CAST((row_number() OVER (PARTITION BY labels ORDER BY {H}, event_id) - 1) % 5 AS INTEGER)
       AS fold FROM evt""")
def x8_stratified_folds(spark, sf):
    return smp.stratified_folds(evt(spark, sf).select("event_id", "labels"), "labels", "event_id", 5, 42)


@register("j1_j2_tagged_union", EVT + """
SELECT dataset, labels, COUNT(*) AS n, round(SUM(value), 6) AS sum_value FROM (
  SELECT 'sig' AS dataset, * FROM evt WHERE labels = 1
  UNION ALL SELECT 'bkg' AS dataset, * FROM evt WHERE labels = 0) GROUP BY ALL""")
def j1_j2_tagged_union(spark, sf):
    e = evt(spark, sf)
    u = smp.tag_union({"sig": metrics.signal(e), "bkg": e.filter(F.col("labels") == 0)})
    return u.groupBy("dataset", "labels").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6)
                                              .alias("sum_value"))


@register("j3_align_scores", EVT + """
SELECT f.event_id, f.value, f.user_id, s.labels, round(s.score, 9) AS score
FROM (SELECT event_id, value, user_id FROM evt) f JOIN (SELECT event_id, labels, score FROM evt) s
  ON f.event_id = s.event_id""")
def j3_align_scores(spark, sf):
    e = evt(spark, sf)
    feats = e.select("event_id", "value", "user_id")
    scores = e.select("event_id", "labels", F.round("score", 9).alias("score"))
    return feats.join(scores, "event_id", "inner")


@register("j4_complement", EVT + f""",
t AS (SELECT event_id FROM evt QUALIFY row_number() OVER (ORDER BY {sql_hash_hex(24601, 'event_id')}, event_id)
      <= ceil(COUNT(*) OVER () * 0.05))
SELECT event_id, labels FROM evt WHERE event_id NOT IN (SELECT event_id FROM t)""")
def j4_complement(spark, sf):
    e = evt(spark, sf).select("event_id", "labels")
    test = smp.exact_split(e, 0.05, 24601, "event_id").filter(F.col("is_test") == 1)
    return smp.complement(e, test, "event_id")
