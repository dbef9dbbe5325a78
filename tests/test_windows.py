"""Closing windows: reset, late rows, restart, bounded state."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sigbg.streaming import stream as st
from sigbg.streaming import windows as win

DAY0 = datetime(2024, 3, 1)


def day(n, hour=1):
    return DAY0 + timedelta(days=n, hours=hour)


def store_of(spark, path, **kw):
    return win.WindowStore(spark, path, ["k"], {"n": F.lit(1).cast("long"), "v": F.col("v")}, **kw)


def frame(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, k string, v double")


def test_windows_close_and_late_rows_are_counted(spark):
    path, _ = st.fresh_paths(spark, "test-windows")
    s = store_of(spark, path)
    s.add(frame(spark, [(day(0), "a", 1.0), (day(0, 3), None, 2.0), (day(1), "a", 4.0)]), 0)
    s.add(frame(spark, [(day(0), "a", 100.0), (day(1, 5), "a", 8.0), (day(2), "b", 16.0), (None, "a", 5.0)]), 1)
    s.add(frame(spark, []), 2)
    s.add(frame(spark, [(day(1), "a", 100.0), (day(2, 9), "b", 32.0)]), 3)
    no = F.date_diff(F.to_date(F.timestamp_micros("win")), F.lit(DAY0.date()))
    got = {(r.d, r.k): (r.n, r.v, r.open) for r in s.results().withColumn("d", no).collect()}
    assert got == {(0, "a"): (1, 1.0, False), (0, None): (1, 2.0, False), (1, "a"): (2, 12.0, False), (2, "b"): (2, 48.0, True)}
    assert {(r.d): r.n for r in s.late().withColumn("d", no).collect()} == {0: 1, 1: 1, None: 1}


def test_a_batch_run_again_counts_once_and_state_is_bounded(spark):
    path, _ = st.fresh_paths(spark, "test-windows-again")
    s = store_of(spark, path, delay=2 * 86_400)
    for i in range(12):
        rows = [(day(i), "a", 1.0), (day(max(0, i - 1)), "a", 1.0)]
        s.add(frame(spark, rows), i)
        if i % 3 == 0:
            store_of(spark, path, delay=2 * 86_400).add(frame(spark, rows), i)      # the driver was lost before the commit
        assert len(win.versions(spark, f"{path}/state")) <= 2 and s.state()[0].count() <= 4
    assert s.results().agg(F.sum("n")).first()[0] == 24 and s.late().count() == 0


def test_restart_goes_on(spark):
    path, ck = st.fresh_paths(spark, "test-windows-restart")
    src = path + "-src"
    schema = "ts timestamp, k string, v double"
    for i in range(3):
        frame(spark, [(day(i), "a", 1.0)]).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: st.file_stream(spark, src, spark.createDataFrame([], schema).schema, 1)
    store_of(spark, path).run(stream(), ck)
    store_of(spark, path).run(stream(), ck)                                    # nothing new
    frame(spark, [(day(0), "a", 1.0), (day(5), "a", 1.0)]).coalesce(1).write.mode("append").parquet(src)
    s = store_of(spark, path)
    s.run(stream(), ck)
    assert s.results().agg(F.sum("n")).first()[0] == 4 and s.late().agg(F.sum("n")).first()[0] == 1
