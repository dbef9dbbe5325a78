"""Parquet / JSON sinks and the named-table store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of a run's summary and of a parameter search's record, one JSON object a run.
_T = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "m": T.MapType(T.StringType(), T.StringType())}
RUN_FIELDS = {"run": "s", "channel": "s", "mode": "s", "timestamp": "s", "arch": "s", "layers": "l", "batch_size": "l", "dropout": "d",
              "epochs": "l", "time": "d", "train_acc": "d", "test_acc": "d", "test_auc": "d", "params": "m"}
SEARCH_FIELDS = {"run": "s", "auc": "d", "error": "s", "best_iteration": "l", "counter": "l", "seconds": "l", "params": "m", "iterations": "d"}
RUN_SCHEMA = T.StructType([T.StructField(c, _T[k]) for c, k in RUN_FIELDS.items()])
SEARCH_SCHEMA = T.StructType([T.StructField(c, _T[k]) for c, k in SEARCH_FIELDS.items()])


def convert(spark: SparkSession, src: str, out: str, schema: T.StructType | None = None,
            fmt: str = "parquet") -> DataFrame:
    """Read with a pinned schema (taken from the first file when not given), write snappy Parquet.

    Spark splits the input into partitions, so memory is bounded like the
    reference's fixed-size chunks; the incremental variant is
    ``streaming.stream.ingest``.
    """
    if schema is None:
        schema = spark.read.format(fmt).load(src).schema
    df = spark.read.schema(schema).format(fmt).load(src)
    df.write.mode("overwrite").option("compression", "snappy").parquet(out)
    return spark.read.parquet(out)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Prepared-matrix cache as Parquet (survives executor loss, unlike ``cache``)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def store_frames(frames: Mapping[str, DataFrame], path: str, key: str = "dataset") -> None:
    """Several named frames in one table, partitioned by name (pruned on read)."""
    out = None
    for name, f in frames.items():
        t = f.withColumn(key, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    out.write.mode("overwrite").partitionBy(key).parquet(path)


def load_frame(spark: SparkSession, path: str, name: str, key: str = "dataset") -> DataFrame:
    return spark.read.parquet(path).filter(F.col(key) == name)


def write_predictions(scored: DataFrame, path: str) -> DataFrame:
    """Scored table sink."""
    scored.write.mode("overwrite").parquet(path)
    return scored.sparkSession.read.parquet(path)


def append_runs(records: DataFrame, path: str, schema: T.StructType = RUN_SCHEMA) -> None:
    """Append run records to a JSON registry; absent fields are null, unknown ones an error."""
    unknown = [c for c in records.columns if c not in schema.fieldNames()]
    if unknown:
        raise ValueError(f"the registry has no fields {unknown}")
    records.select(*[(F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]) \
           .write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType = RUN_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)
