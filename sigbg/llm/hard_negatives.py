"""Hard negatives: for anchors and their nearest rows of the same label, near rows of other labels (operator 11).

Anchors - a stated share of all rows - go to all tasks in rounds of at most
ANCHORS vectors, a bound that the data can't move; every task scores them
against the rows it holds by packed products (``kronecker``), so that the
vectors are never shuffled and no pair of a row and an anchor is ever written.
A task keeps the first few rows of each anchor; those of all tasks are ranked
by a window.  A second pass with the positives' scores finds the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .kronecker import LONG, matrix, scores

#: Anchors of a round, and of one product.
ANCHORS = 16_384
TILE = 256
#: Candidates of one product.
ROWS = 4_096
#: Components stop here, so that they fit a long.
MOST = float(2 ** 62)
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(uid, vec_id, label, q) of the rows that take part: floor(scale * x) of every component, as a stored table.

    Rows with a null label, a null vector, or a null or non-finite component
    are left out.  A null id sorts behind all others.  uid tells rows apart.
    """
    v = rows["embedding"]
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    q = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(MOST)), F.lit(-MOST))))
    out = rows.filter(rows["label"].isNotNull() & v.isNotNull() & whole).select(
        F.monotonically_increasing_id().alias("uid"), F.coalesce(rows["vec_id"].cast("long"), F.lit(LONG)).alias("vec_id"),
        rows["label"].cast("long").alias("label"), q.cast("array<long>").alias("q"))
    return write_through(out, "negatives-vectors")


class Best:
    """The first k rows of each group so far: highest score, then smallest id, then smallest uid."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.score = np.full((groups, k), -LONG - 1, dtype=np.int64)
        self.ident = np.full((groups, k), LONG, dtype=np.int64)
        self.uid = np.full((groups, k), LONG, dtype=np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray, uid: np.ndarray) -> None:
        last = self.k - 1
        at, low = self.score[group, last], self.ident[group, last]
        new = (score > at) | ((score == at) & (ident <= low))
        if not new.any():
            return
        group, score, ident, uid = group[new], score[new], ident[new], uid[new]
        seen = np.unique(group)
        group = np.concatenate([np.repeat(seen, self.k), group])
        score = np.concatenate([self.score[seen].ravel(), score])
        ident = np.concatenate([self.ident[seen].ravel(), ident])
        uid = np.concatenate([self.uid[seen].ravel(), uid])
        order = np.lexsort((uid, ident, ~score, group))
        place = np.arange(len(order)) - np.searchsorted(group[order], group[order], side="left")
        kept = order[place < self.k]
        for mine, x in ((self.score, score), (self.ident, ident), (self.uid, uid)):
            mine[seen] = x[kept].reshape(len(seen), self.k)

    def found(self) -> tuple[np.ndarray, ...]:
        """(group, score, ident, uid) of the rows held."""
        g, i = np.nonzero(self.uid < LONG)
        return g, self.score[g, i], self.ident[g, i], self.uid[g, i]


class Anchors:
    """Anchors of one round: uid, vec_id, label and a matrix of components."""

    def __init__(self, table: pa.Table):
        self.uid, self.vec_id, self.label = (table.column(c).to_numpy().astype(np.int64) for c in ("uid", "vec_id", "label"))
        col = table.column("q").combine_chunks()
        d = int(np.diff(col.offsets.to_numpy()).max(initial=0)) if len(col) else 0
        q = matrix(col, d)
        small = np.abs(q).max(initial=0) < 1 << 15
        self.q = q.astype(np.int16) if small else q

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, exact scores, and the rows' uid, id, label), a bounded product at a time."""
        for first in range(0, batch.num_rows, ROWS):
            b = batch.slice(first, ROWS)
            uid, ident, label = (b.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "vec_id", "label"))
            c = matrix(b.column("q"), self.q.shape[1])
            for at in range(0, len(self.uid), TILE):
                part = slice(at, min(at + TILE, len(self.uid)))
                yield part, scores(self.q[part].astype(np.int64), c), uid, ident, label


def _batch(schema: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in schema.split(", ")])


POSITIVES = "a long, p_score long, p_id long, p_uid long"
NEGATIVES = "a long, p_rank long, score long, ident long, uid long"


def _positives(vectors: DataFrame, shared, k: int) -> DataFrame:
    """(a, p_rank, p_score, p_id): the first k other rows of each anchor's label; a is the anchor's place in its round."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        best = Best(len(anchors.uid), k)
        for b in batches:
            for part, s, uid, ident, label in anchors.tiles(b):
                fits = (label[None, :] == anchors.label[part, None]) & (s >= best.score[part, -1:])
                g, i = np.nonzero(fits)
                other = anchors.uid[part][g] != uid[i]
                g, i = g[other], i[other]
                best.add(g + part.start, s[g, i], ident[i], uid[i])
        yield _batch(POSITIVES, *best.found())

    w = Window.partitionBy("a").orderBy(F.col("p_score").desc(), "p_id", "p_uid")
    return vectors.mapInArrow(task, POSITIVES).withColumn("p_rank", F.row_number().over(w)).filter(F.col("p_rank") <= k)


def _negatives(vectors: DataFrame, shared, bounds, n_pos: int, k: int) -> DataFrame:
    """(a, p_rank, score, ident, uid, rank): the first k rows of other labels within each positive's bounds."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        low, high = bounds.value                         # (anchors, n_pos); an empty range where there is no positive
        best = Best(len(anchors.uid) * n_pos, k)
        for b in batches:
            for part, s, uid, ident, label in anchors.tiles(b):
                worst = best.score.reshape(len(anchors.uid), n_pos, k)[part, :, -1]
                least = np.where(low[part] <= high[part], np.maximum(low[part], worst), LONG).min(axis=1)
                most = high[part].max(axis=1)
                g, i = np.nonzero((label[None, :] != anchors.label[part, None]) & (s >= least[:, None]) & (s <= most[:, None]))
                v, g = s[g, i], g + part.start
                for j in range(n_pos):
                    ok = (v >= low[g, j]) & (v <= high[g, j])
                    best.add(g[ok] * n_pos + j, v[ok], ident[i[ok]], uid[i[ok]])
        g, score, ident, uid = best.found()
        yield _batch(NEGATIVES, g // n_pos, g % n_pos + 1, score, ident, uid)

    w = Window.partitionBy("a", "p_rank").orderBy(F.col("score").desc(), "ident", "uid")
    return vectors.mapInArrow(task, NEGATIVES).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rounds(anchors: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Anchors dealt by a hash of uid to rounds of at most ``most``, as counted."""
    n = anchors.count()
    parts = max(1, -(-n // most))
    while True:
        dealt = anchors.withColumn("round", F.pmod(F.xxhash64("uid"), F.lit(parts)))
        if parts == 1 or dealt.groupBy("round").count().agg(F.max("count")).first()[0] <= most:
            return dealt, parts if n else 0
        parts *= 2


def mine(rows: DataFrame, every: int = 100, n_pos: int = 5, n_neg: int = 5, low: int = 80, high: int = 100, scale: int = 256,
         per_round: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``rows(vec_id, label, embedding)``.

    Anchors: vec_id divisible by ``every``.  Scores are integer inner products
    of floor(scale * x).  Positives: the ``n_pos`` other rows of the anchor's
    label with the highest scores; negatives of a positive: the ``n_neg`` rows
    of other labels with the highest scores between ``low`` and ``high`` per
    cent of the positive's.  Ties go to the smaller id.

    Rows without a label or with an incomplete vector take no part.  A null id
    is never an anchor, comes after all others and comes back null.  Rows that
    repeat an id are rows of their own.  Components missing in the shorter of
    two vectors count as 0; scores beyond a long stop at its ends.  A positive
    below 0 has no negatives.  No anchors: no rows.  Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = quantised(rows, scale)
    dealt, n = rounds(vectors.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != F.lit(LONG))), per_round)
    out = spark.createDataFrame([], SCHEMA)
    for r in range(n):
        block = Anchors(dealt.filter(F.col("round") == r).select("uid", "vec_id", "label", "q").toArrow())
        shared = spark.sparkContext.broadcast(block)
        pos = _positives(vectors, shared, n_pos).select("a", "p_rank", "p_score", "p_id").toArrow()
        a, j, score, ident = (pos.column(c).to_numpy().astype(np.int64) for c in ("a", "p_rank", "p_score", "p_id"))
        size = (len(block.uid), n_pos)
        lo, hi = np.full(size, LONG, dtype=np.int64), np.full(size, -LONG, dtype=np.int64)
        # low * p <= 100 * s <= high * p, in whole numbers of any width.
        lo[a, j - 1] = [min(LONG, max(-LONG, -(-low * int(p) // 100))) for p in score]
        hi[a, j - 1] = [min(LONG, max(-LONG, high * int(p) // 100)) for p in score]
        neg = _negatives(vectors, shared, spark.sparkContext.broadcast((lo, hi)), n_pos, n_neg)
        # One row for each positive of the round: at most per_round * n_pos.
        names = spark.createDataFrame(pa.table({"a": pa.array(a), "p_rank": pa.array(j), "anchor_id": pa.array(block.vec_id[a]),
                                                "positive_id": pa.array(ident), "positive_score": pa.array(score)})) \
            if len(a) else None
        if names is not None:
            real = lambda c: F.when(F.col(c) != F.lit(LONG), F.col(c)).alias(c)
            out = out.unionByName(neg.join(F.broadcast(names), ["a", "p_rank"]).select(
                "anchor_id", real("positive_id"), F.col("rank").cast("int").alias("rank"), real("ident").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score")))
    return out


SQL = """
WITH l AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM l a JOIN l b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
