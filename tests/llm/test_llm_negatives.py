import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigbg.llm import hard_negatives, kronecker

SCHEMA = "vec_id long, embedding array<float>, label int"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 23), st.integers(1, 70), st.sampled_from([1, 40, 300, 1 << 15, 1 << 20, 1 << 25, 1 << 45]), st.integers(0, 99))
def test_packed_products_are_exact(na, nc, d, most, seed):
    r = np.random.default_rng(seed)
    a, c = (r.integers(-most, most, (n, d), endpoint=True) for n in (na, nc))
    want = a.astype(object) @ c.astype(object).T
    assert (kronecker.scores(a, c) == np.clip(want, -kronecker.LONG, kronecker.LONG)).all()


def test_several_candidates_share_a_word():
    a, c = np.full((1, 64), 200), np.arange(64 * 6).reshape(6, 64) % 211
    bits = kronecker.field_bits(a, c)
    fields = kronecker.WORD_BITS // bits
    words = kronecker.pack(c, fields, bits)
    assert fields >= 2 and words.shape == (-(-6 // fields), 64)
    assert (kronecker.unpack((a.astype(float) @ words.T).astype(np.int64), 6, fields, bits) == a @ c.T).all()


def plain(rows, every=100, n_pos=5, n_neg=5):
    """Brute force over (vec_id, vector, label)."""
    use = []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use.append((len(use), 2 ** 63 - 1 if i is None else i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y))
    out = []
    for a in use:
        if a[1] % every or a[1] == 2 ** 63 - 1:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[1], b[0], b[3]) for b in use if b[0] != a[0])
        pos = [s for s in scored if s[3] == a[3]][:n_pos]
        for p in pos:
            neg = [s for s in scored if s[3] != a[3] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:n_neg]
            real = lambda x: None if x == 2 ** 63 - 1 else x
            out += [(a[1], real(p[1]), k + 1, real(s[1]), -p[0], -s[0]) for k, s in enumerate(neg)]
    return sorted(out, key=str)


def table(n, labels=3, seed=1):
    """Vectors with ties, repeated rows, one vector that a third of all rows share, and odd rows."""
    r = random.Random(seed)
    hot = [0.25, 0.5, -0.125, 0.25]
    rows = [(i, hot if i % 3 == 0 else [r.choice((-0.5, 0.25, 0.75, 0.3)) for _ in range(4)], r.randrange(labels)) for i in range(n)]
    rows += [(7, [0.5, 0.5, 0.5, 0.5], 1)] * 2 + [(200, hot, 2)] * 2
    rows += [(400, None, 1), (401, [0.1, None, 0.2, 0.3], 1), (402, [0.1, float("nan"), 0.2, 0.3], 1), (403, [float("inf")] * 4, 1),
             (404, hot, None), (None, hot, 1), (None, [0.5, 0.5, 0.0, 0.5], 0), (405, [], 1), (406, [0.5, 0.75], 2)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("per_round", [hard_negatives.ANCHORS, 2])
def test_mining_equals_brute_force(spark, per_round, monkeypatch):
    rows = table(350)
    monkeypatch.setattr(hard_negatives, "ROWS", 37)
    monkeypatch.setattr(hard_negatives, "TILE", 2)
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("uid", "q", "a", "p_rank", "round", "rank", "score"):
        df = df.withColumn(c, F.lit("x"))
    got = hard_negatives.mine(df, per_round=per_round)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_mining_edge_tables(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(5, [1.0], 1), (None, [1.0], 2)], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1), (200, [1.0], 2)], SCHEMA)
    assert hard_negatives.mine(alone).count() == 0                  # no positive, so no negative
    huge = spark.createDataFrame([(100, [3e38, 1.0], 1), (1, [3e38, 1.0], 1), (2, [3e38, 0.5], 2), (3, [0.0, 0.5], 2)], SCHEMA)
    got = [tuple(x) for x in hard_negatives.mine(huge).collect()]
    assert got == [(100, 1, 1, 2, 2 ** 63 - 1, 2 ** 63 - 1)]        # scores stop at the ends of a long
    below = spark.createDataFrame([(100, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)], SCHEMA)
    assert hard_negatives.mine(below).count() == 0
