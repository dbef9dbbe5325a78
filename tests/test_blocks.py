"""Order-preserving block index."""

import math
import random
import struct

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigbg.operators import blocks, curves
from sigbg.operators import working_point as wp


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_float_key_is_the_bits(spark):
    r = random.Random(3)
    vals = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), -float("inf"),
            0.1, 0.5, math.nextafter(0.5, 0), math.nextafter(1, 0), math.nextafter(1, 2), math.nextafter(8, 0), 2.0 ** 1023, 2.0 ** -1074 * 3]
    vals += [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(3000)]
    vals += [math.nextafter(2.0 ** e, d) for e in range(-1070, 1023, 7) for d in (0, math.inf)]
    vals = [v for v in vals if v == v]
    got = spark.createDataFrame([(v,) for v in vals], "x double").select("x", blocks.float_key(F.col("x")).alias("k")).collect()
    assert all(g.k == bits(g.x) for g in got)
    odd = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),)], "x double").select(blocks.float_key(F.col("x")).alias("k")).collect()
    assert odd[0].k > odd[2].k and odd[1].k == blocks.NULL_KEY


@pytest.mark.parametrize("rows_per_block", [1, 7, 100])
def test_blocks_are_ordered_and_bounded(spark, rows_per_block):
    r = random.Random(rows_per_block)
    vals = {r.random() for _ in range(300)} | {1 - r.random() * 1e-13 for _ in range(300)} | {-r.expovariate(1e-6) for _ in range(100)} | {0.0}
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = blocks.value_blocks(df, "x", rows_per_block).collect()
    assert len(got) == len(vals)
    ordered = sorted((g.x, g._vblk) for g in got)
    assert [b for _, b in ordered] == sorted(b for _, b in ordered)
    sizes = {}
    for _, b in ordered:
        sizes[b] = sizes.get(b, 0) + 1
    assert max(sizes.values()) <= 2 * rows_per_block and len(sizes) <= 4 * len(vals) / rows_per_block + 50


def test_one_value_and_other_types(spark):
    same = spark.createDataFrame([(0.5, i) for i in range(50)], "x double, i long")
    assert blocks.value_blocks(same, "x", 10).select("_vblk").distinct().count() == 1
    d = spark.range(500).select(((F.col("id") * 7919) % 500 - 100).alias("n"), F.concat(F.lit("k"), (F.col("id") * 31 % 500).cast("string")).alias("s"),
                                F.date_add(F.lit("2020-02-02").cast("date"), (F.col("id") * 13 % 500).cast("int")).alias("d"))
    for c in ("n", "s", "d"):
        got = sorted((g[c], g["_vblk"]) for g in blocks.value_blocks(d, c, 10).select(c, "_vblk").collect())
        assert [b for _, b in got] == sorted(b for _, b in got) and len({b for _, b in got}) > 20
    with pytest.raises(TypeError):
        blocks.value_blocks(d.select(F.array("n").alias("a")), "a", 10)


def test_edges_are_a_table_of_all_rows(spark):
    d = spark.range(10_000).select((F.rand(3) * 2 - 1).alias("x")).cache()
    index = blocks.block_index(d, blocks.order_key(d, "x"), 50)
    e = index.edges().agg(F.sum("rows").alias("n"), F.max("rows").alias("m")).first()
    assert e.n == 10_000 and e.m <= 100 and len(index.passes) > 1


def test_results_do_not_depend_on_block_size(spark):
    r = random.Random(9)
    rows = [(i, r.choice((0, 1)), r.choice((r.random(), 1 - 1e-15 * r.randrange(50), 0.25))) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, labels int, score double")
    whole = sorted(map(tuple, curves.roc_curve(df).collect()), key=str)
    assert sorted(map(tuple, curves.roc_curve(df, rows_per_block=3).collect()), key=str) == whole
    want = {g.k: g.rn for g in df.withColumn("rn", F.row_number().over(Window.orderBy("score", "k"))).collect()}
    assert {g.k: g.rank for g in wp.global_rank(df, "score", "k", rows_per_block=3).collect()} == want


def test_ties_of_a_text_key_keep_its_order(spark):
    """Keys that look like numbers stay in the order of texts."""
    df = spark.createDataFrame([(str(i), 0, 0.5) for i in range(200)], "k string, labels int, score double")
    kept, at = wp.rejection_working_point(df, "k", rejection=0.875)
    assert at == 0.5 and sorted(g.k for g in kept.collect()) == sorted(map(str, range(200)))[:25]
