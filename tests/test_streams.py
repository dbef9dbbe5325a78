"""Streaming restarts: the file sink + checkpoint give exactly-once ingest."""

from conftest import SF_SMALL
from sigbg.streaming import stream as st


def test_ingest_restart_is_exactly_once(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    out, ck = st.fresh_paths(spark, "test-restart")
    st.ingest(st.file_stream(spark, f"{SF_SMALL}/events*.parquet", schema), out, ck)
    n1 = spark.read.parquet(out).count()
    # Same checkpoint: a restarted query must not re-ingest the files it already committed.
    st.ingest(st.file_stream(spark, f"{SF_SMALL}/events*.parquet", schema), out, ck)
    n2 = spark.read.parquet(out).count()
    assert n1 == n2 == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()


def test_update_state_is_latest_per_key(spark):
    from pyspark.sql import functions as F
    from sigbg.sources.fixtures import evt_view
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    out, ck = st.fresh_paths(spark, "test-update")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    state = st.run_update(st.windowed_confusion(evt_view(st.file_stream(spark, f"{SF_SMALL}/events*.parquet", schema))),
                          ["day", "bin"], out, ck)
    total = state.agg(F.sum(F.col("tp_b") + F.col("fp_b"))).first()[0]
    assert total == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert state.groupBy("day", "bin").count().filter("count > 1").count() == 0
