"""The registered queries of the operators: thin wrappers that derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (burst_trie, chunk_dedup, cuckoo_dedup, curve_packing, hard_negatives, html_text, license_scan, near_dedup,
               pfor_files, quality_lm, spot_signatures, systematic_mix, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@_query("op4_cuckoo_dedup", """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.dedup(read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query("op8_systematic_mix", systematic_mix.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return systematic_mix.mix(read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "size", "source_size", "target", "taken")


@_query("op10_quality_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_query("op1_curve_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack(read_table(spark, sf_dir, "documents"))


@_query("op2_pfor_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor_files.round_trip(read_table(spark, sf_dir, "documents"))


@_query("op9_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read_table(spark, sf_dir, "documents"), k=3, percent=85, symbols=32) \
        .drop("k_id", "k_hash", "group")


@_query("op3_chunk_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.passages(read_table(spark, sf_dir, "documents")).drop("k_id", "k_hash")


@_query("op5_html_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


@_query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(read_table(spark, sf_dir, "documents"))


@_query("op7_spot_signatures")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.fingerprints(read_table(spark, sf_dir, "documents"))


@_query("op11_hard_negatives", hard_negatives.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = read_table(spark, sf_dir, "embeddings") \
        .withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows)


@_query("op12_conversation_trie", burst_trie.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


@_query("op13_warc_index", warc.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read_table(spark, sf_dir, "pages")) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
