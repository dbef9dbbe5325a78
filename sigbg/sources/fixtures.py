"""Event-table views over the driver tables (see FIXTURES.md).

Each view exists twice: as a Spark DataFrame builder and as DuckDB SQL text
for the oracle.  The scores are fixed formulas (L10) so an exact oracle
exists without a trained model; they carry no physics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import linear_score
from .tables import read_table

# Coefficients of the fixture scorers.
CAND_Q_COEF = 0.05
CAND_D_COEF = -20.0
SIGNAL_EVENT_TYPES = ("purchase", "signup")


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from lineitem: label R, fit variables price and discount-tax."""
    li = read_table(spark, sf_dir, "lineitem")
    # The sum has two decimals; rounding it makes equal candidates score equally in every engine.
    score = linear_score({"l_quantity": CAND_Q_COEF, "l_discount": CAND_D_COEF}, places=6)
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        (F.col("l_returnflag") == "R").cast("int").alias("labels"),
        F.col("l_extendedprice").alias("mbc"),
        (F.col("l_discount") - F.col("l_tax")).alias("deltae"),
        F.col("l_linestatus").alias("channel"),
        F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"),
        score.alias("score"),
    )


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a unique key: label purchase/signup, score value/(1+value)."""
    return evt_view(read_table(spark, sf_dir, "events"))


def evt_view(ev: DataFrame) -> DataFrame:
    """The ``evt`` columns over an events frame (batch or streaming)."""
    return ev.select(
        F.col("event_id"), F.col("ts"),
        F.col("event_type").isin(*SIGNAL_EVENT_TYPES).cast("int").alias("labels"),
        F.col("value").alias("mbc"),
        F.col("user_id").cast("double").alias("deltae"),
        F.col("event_type").alias("channel"),
        F.col("value"), F.col("user_id"),
        (F.col("value") / (F.lit(1.0) + F.col("value"))).alias("score"),
    )


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64-float feature arrays with a binary label (label >= 5)."""
    em = read_table(spark, sf_dir, "embeddings")
    return em.select(F.col("vec_id"), F.col("embedding"), F.col("label"),
                     (F.col("label") >= 5).cast("int").alias("labels"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbalanced labelled documents: labels = quality, feature n_chars."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    return lab.join(docs, "doc_id", "inner").select(
        "doc_id", F.col("quality").alias("labels"), "n_chars")


# ---------------------------------------------------------------- DuckDB text

CAND_SQL = f"""cand AS (
  SELECT l_orderkey, l_linenumber,
         CAST(l_returnflag = 'R' AS INTEGER) AS labels,
         l_extendedprice AS mbc, l_discount - l_tax AS deltae, l_linestatus AS channel,
         l_quantity, l_extendedprice, l_discount, l_tax,
         1.0 / (1.0 + exp(-round(CAST({CAND_Q_COEF} AS DOUBLE) * l_quantity + CAST({CAND_D_COEF} AS DOUBLE) * l_discount, 6))) AS score
  FROM lineitem)"""

EVT_SQL = """evt AS (
  SELECT event_id, ts, CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS labels,
         value AS mbc, CAST(user_id AS DOUBLE) AS deltae, event_type AS channel,
         value, user_id, value / (1.0 + value) AS score
  FROM events)"""

VEC_SQL = """vec AS (
  SELECT vec_id, embedding, label, CAST(label >= 5 AS INTEGER) AS labels FROM embeddings)"""

QUALITY_SQL = """quality AS (
  SELECT l.doc_id, l.quality AS labels, d.n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
