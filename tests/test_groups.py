"""Mergeable group functions and the buffered shuffle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigbg.operators import groups
from sigbg.operators import sample as smp

SCHEMA = "n bigint, mean double, spread double, largest array<double>"


@pytest.mark.parametrize("most", [10_000, 2])
def test_hot_group_is_never_held(spark, monkeypatch, most):
    monkeypatch.setattr(groups, "MAX_STATES", most)
    r = random.Random(1)
    rows = [("hot" if i % 3 else r.choice(("a", "b", None, "c")), None if i % 50 == 0 else r.gauss(5, 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "ch string, v double").repartition(7)
    got = {x.ch: x for x in groups.apply_mergeable(df, "ch", ["v"], groups.moments_and_largest("v"), SCHEMA).collect()}
    assert set(got) == {c for c, _ in rows}
    for c, x in got.items():
        v = np.array([v for k, v in rows if k == c and v is not None])
        assert x.n == len(v) and x.mean == pytest.approx(v.mean()) and x.spread == pytest.approx(v.std())
        assert x.largest == pytest.approx(sorted(v, reverse=True)[:3])


def test_one_state_a_task_moves(spark):
    df = spark.range(20_000, numPartitions=6).select(F.lit("x").alias("ch"), F.col("id").cast("double").alias("v"))
    fn = groups.GroupFunction(lambda: 0, lambda s, c: s + len(c["v"]), lambda a, b: a + b, lambda s: {"n": s})
    out = groups.apply_mergeable(df, "ch", ["v"], fn, "n bigint")
    assert out.first().n == 20_000
    assert groups.apply_mergeable(df.limit(0), "ch", ["v"], fn, "n bigint").count() == 0


@pytest.mark.parametrize("buffer", [1, 10, 400, 10_000])
def test_buffered_shuffle(spark, buffer):
    df = spark.range(5000, numPartitions=3).withColumn("x", F.col("id") * 2)
    got = smp.buffer_shuffle(df, buffer).collect()
    assert sorted(r.id for r in got) == list(range(5000)) and all(r.x == 2 * r.id for r in got)
    for p in range(3):
        part = [r for r in got if r.part == p]
        assert [r.place for r in part] == list(range(len(part)))
        assert max(r.source_place - r.place for r in part) <= buffer
        if buffer == 1:
            assert all(r.source_place == r.place for r in part)
        if buffer >= 400:
            assert np.mean([abs(r.source_place - r.place) for r in part]) > 100
    assert [tuple(r) for r in smp.buffer_shuffle(df, buffer).collect()] == [tuple(r) for r in got]


def test_oversampling_splits_a_tiny_class(spark, monkeypatch):
    """The draws don't depend on the shares; a class of one row is dealt to many keys."""
    rows = [(i, 0) for i in range(900)] + [(5000, 1)] + [(6000 + i, None) for i in range(7)]
    df = spark.createDataFrame(rows, "k long, y int")
    want = sorted(((r.k, r.y) for r in smp.oversample(df, "y", 3, "k").collect()), key=str)
    monkeypatch.setattr(smp, "SLOTS_PER_KEY", 10)
    got = smp.oversample(df, "y", 3, "k")
    assert sorted(((r.k, r.y) for r in got.collect()), key=str) == want
    assert len(want) == 2700 and sum(k == 5000 for k, _ in want) == 900
