"""Structured Streaming forms of the incremental operators.

* T1 ingest: file stream with a pinned schema, ``maxFilesPerTrigger``
  micro-batches, exactly-once Parquet file sink.
* T2/T3 running metrics: event-time windows aggregated in ``update`` mode;
  each micro-batch's changed rows are appended with their batch id, and the
  current state is "latest row per key" (``max_by``).  Windows are never
  closed, so an event counts however late it comes; state is one row per
  (window, score bin) - 1000 a day whatever the traffic.  Pass ``watermark``
  to close windows instead; events later than it are then not counted.  Exact
  streaming AUC would need every distinct score, so T2 keeps fixed score
  bins, which is stated in the output (``auc_binned``).
* T4 scoring: a fitted Spark ML model applied to the stream.

Checkpoints and sinks live under the session's shared checkpoint folder, a
fresh sub-folder per run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import guarded_logit
from ..operators.prefix import fixed_blocks, running
from ..session import scratch_path

SCORE_BINS = 1000


def file_stream(spark: SparkSession, path_glob: str, schema: StructType, max_files_per_trigger: int = 256,
                fmt: str = "parquet") -> DataFrame:
    """T1 source: files matching the glob, schema pinned (no inference per file).

    ``max_files_per_trigger`` bounds a micro-batch (the reference's fixed-size
    chunks); one file per trigger would make a large backlog crawl, so the
    default lets each micro-batch use the whole cluster.
    """
    return (spark.readStream.schema(schema).format(fmt)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path_glob))


def ingest(sdf: DataFrame, out_path: str, checkpoint: str) -> None:
    """T1 sink: append to Parquet (snappy) until the available input is consumed."""
    q = (sdf.writeStream.format("parquet").option("compression", "snappy")
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def run_update(sdf: DataFrame, keys: Sequence[str], out_path: str, checkpoint: str) -> DataFrame:
    """Run an update-mode aggregation to completion; return the final state table."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out_path)

    q = (sdf.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    spark = sdf.sparkSession
    hist = spark.read.parquet(out_path)
    vals = [c for c in hist.columns if c not in keys and c != "_batch"]
    latest = hist.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("_batch")).alias("_v"))
    return latest.select(*keys, *[F.col("_v")[c].alias(c) for c in vals])


def _event_time(sdf: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    """``_et``: the event time as it is; windows over a zone-less time don't depend on the session's zone.

    A zone-less time cannot carry a watermark and is read in the session's zone then.
    """
    if not watermark:
        return sdf.withColumn("_et", F.col(ts))
    return sdf.withColumn("_et", F.col(ts).cast("timestamp")).withWatermark("_et", watermark)


def windowed_confusion(sdf: DataFrame, ts: str = "ts", label: str = "labels", score: str = "score",
                       window: str = "1 day", watermark: str | None = None, cut: float = 0.5,
                       bins: int = SCORE_BINS) -> DataFrame:
    """T2 state: per (window, score bin) class counts and correct decisions."""
    s = _event_time(sdf, ts, watermark)
    b = F.least(F.floor(F.col(score) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    y = F.col(label).cast("bigint")
    return (s.groupBy(F.window("_et", window).alias("w"), b.alias("bin"))
             .agg(F.sum(y).alias("tp_b"), F.sum(F.lit(1) - y).alias("fp_b"),
                  F.sum(((F.col(score) > cut).cast("bigint") == y).cast("bigint")).alias("correct"))
             .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "bin", "tp_b", "fp_b", "correct"))


def metrics_from_state(state: DataFrame) -> DataFrame:
    """T2 result: per window n, accuracy and AUC over the score bins (ties within a bin count half)."""
    cum = running(state, order=["bin"], values={"tp": "tp_b"}, block=fixed_blocks("bin", 0, SCORE_BINS, 16),
                  partition_by=["day"], descending=True)
    return cum.groupBy("day").agg(
        (F.sum("tp_b") + F.sum("fp_b")).alias("n"),
        F.round(F.try_divide(F.sum("correct"), F.sum("tp_b") + F.sum("fp_b")), 9).alias("accuracy"),
        F.round(F.try_divide(F.sum(F.col("fp_b") * (F.col("tp") - F.col("tp_b") / F.lit(2.0))),
                             F.sum("tp_b") * F.sum("fp_b")), 9).alias("auc_binned"))


def windowed_pearson(sdf: DataFrame, pivot: str, ts: str = "ts", score: str = "score",
                     window: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Pearson of the guarded logit of the score with a pivot, per window."""
    s = _event_time(sdf, ts, watermark)
    return (s.groupBy(F.window("_et", window).alias("w"))
             .agg(F.count(F.lit(1)).alias("n"), F.corr(guarded_logit(score), F.col(pivot).cast("double")).alias("r"))
             .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "n", "r"))


def score_stream(model, sdf: DataFrame, out_path: str, checkpoint: str, keep: Sequence[str]) -> None:
    """T4: apply a fitted model to the stream and append the scores to Parquet."""
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(sdf).select(*keep, vector_to_array("probability").getItem(1).alias("score"))
    ingest(scored, out_path, checkpoint)


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    return scratch_path(spark, name + "-out"), scratch_path(spark, name + "-ckpt")
