"""Packing along a space-filling curve (operator 1).

A document's vector counts its words in ``BUCKETS`` hashed buckets, damped and
scaled to length one, and is projected to ``DIMS`` dimensions by fixed random
signs.  Each coordinate is cut to ``LEVEL_BITS`` bits (by a logistic law close
to the normal one that such projections follow) and the point becomes a key of
the Hilbert curve.  Documents are range-sorted by their place on the curve -
the key, then a hash of the id, so that a key shared by a third of all rows is
still spread - and their tokens form one stream in that order.  The stream is
cut every ``length`` tokens: no id is lost, no sequence but the last is short.

The range edges are quantiles over a sample of documents; they decide which
task a document goes to, never its place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .common import NULL_ID, text_of
from .hilbert import hilbert_keys
from .token_store import batches_of, with_offsets
from .tokens import END_ID, Encoder, tokenizer_path

BUCKETS = 512
DIMS = 4
LEVEL_BITS = 10
TIE_BITS = 22
LENGTH = 2048
RUN_BYTES = 16 << 20
MAX_RUNS = 1 << 16
SAMPLE_PER_RUN = 200
_BASE = 0x9E3779B97F4A7C15 | 1


class Projector:
    """Texts to places on the curve."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (BUCKETS, DIMS))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse modulo 2**64, up to n."""
        if len(self.up) <= n:
            size = max(1 << 16, 1 << n.bit_length())
            base, back = (np.full(size, b, dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
            base[0] = back[0] = 1
            self.up, self.down = np.cumprod(base), np.cumprod(back)
        return self.up, self.down

    def word_buckets(self, text: bytes) -> np.ndarray:
        """Hashed bucket of every word (A-Z lower-cased), from one running sum over the text's bytes."""
        data = np.frombuffer(text.lower(), dtype=np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
        first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(first):
            return first
        up, down = self._powers(len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * up[:len(data)])])
        h = (total[end] - total[first]) * down[first]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(40)).astype(np.int64) % BUCKETS

    def keys(self, texts: list[bytes]) -> np.ndarray:
        points = np.zeros((len(texts), DIMS))
        for i, t in enumerate(texts):
            at = self.word_buckets(t)
            if len(at):
                v = np.log1p(np.bincount(at, minlength=BUCKETS))
                points[i] = (v / np.linalg.norm(v)) @ self.signs
        cut = 1.0 / (1.0 + np.exp(-1.702 * points))
        return hilbert_keys(np.minimum((cut * (1 << LEVEL_BITS)).astype(np.int64), (1 << LEVEL_BITS) - 1), LEVEL_BITS)


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("k_id"),
                       text_of(docs["text"]).cast("binary").alias("t"))
    return rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("k_id"), 64 - TIE_BITS))


def curve_order(rows: DataFrame, edges: list[int] | None = None) -> DataFrame:
    """(run, place, k_id, t) for ``rows(k_id, t, tie)``: place on the curve, and the run between two edges that holds it."""
    cut = np.array(edges or [], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Projector()
        for b in batches:
            keys = [p.keys(part) for _, part in batches_of(b.column("t").to_pylist())]
            place = (np.concatenate(keys) if keys else np.zeros(0, np.int64)) << TIE_BITS
            place |= b.column("tie").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(cut, place, side="right").astype(np.int32)), pa.array(place), b.column("k_id"), b.column("t")],
                ["run", "place", "k_id", "t"])

    return rows.select("k_id", "t", "tie").mapInArrow(run, "run int, place long, k_id long, t binary")


def range_edges(rows: DataFrame) -> list[int]:
    """Edges of runs of about RUN_BYTES of text: quantiles of the places of a hashed sample (at most MAX_RUNS numbers)."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("b")).first()
    n = min(MAX_RUNS, math.ceil((size["b"] or 0) / RUN_BYTES))
    if n < 2:
        return []
    part = min(1.0, SAMPLE_PER_RUN * n / size["n"])
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "k_id", "t"), F.lit(1 << 30)) < int(part * (1 << 30)))
    q = curve_order(sample).agg(F.percentile_approx("place", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"]
    return sorted(set(q or []))


def token_stream(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(run, k_id, place, n, in_run, ids): the documents' ids (uint16, end id last) in curve order, as a stored table."""
    path = path or tokenizer_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, run, at = Encoder.of(path), np.array([END_ID], dtype="<u2").tobytes(), None, 0
        for b in batches:
            runs = b.column(0).to_pylist()
            for first, part in batches_of(b.column(3).to_pylist()):
                ids = [x + end for x in enc.ids(part)]
                starts = []
                for r, x in zip(runs[first:], ids):
                    if r != run:
                        run, at = r, 0
                    starts.append(at)
                    at += len(x) // 2
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(ids)), b.column(2).slice(first, len(ids)), b.column(1).slice(first, len(ids)),
                     pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
                    ["run", "k_id", "place", "n", "in_run", "ids"])

    rows = _rows(docs)
    edges = range_edges(rows)
    ordered = curve_order(rows, edges).repartitionById(len(edges) + 1, "run").sortWithinPartitions("run", "place", "k_id", "t")
    return write_through(ordered.mapInArrow(task, "run int, k_id long, place long, n long, in_run long, ids binary"), "pack-stream")


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, place (on
    the curve), and ids (little-endian uint16) ``with_ids``.  Null text counts as empty
    and packs as its end id alone; repeated rows are packed each; a null id
    comes back null.  An empty table gives no
    pieces.  Other columns are ignored.  Only the last sequence is padded.
    """
    rows = with_offsets(token_stream(docs, path), "run", "n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            pieces = []
            for k_id, key, n, pos, raw in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                ids = np.frombuffer(raw.as_py(), dtype="<u2")
                at = 0
                while at < n:
                    seq, off = divmod(pos + at, length)
                    m = min(n - at, length - off)
                    piece = ids[at:at + m]
                    for c, v in zip(out, (k_id, at, m, zlib.crc32(piece.astype("<u4").tobytes()), n, seq, off, key)):
                        c.append(v)
                    if with_ids:
                        pieces.append(piece.tobytes())
                    at += m
            cols = [pa.array(c, pa.int64()) for c in out] + ([pa.array(pieces, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["k_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "place"]
    names += ["ids"] * with_ids
    schema = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names)
    out = rows.select("k_id", "place", "n", (F.col("run_start") + F.col("in_run")).alias("pos"), "ids") \
        .mapInArrow(cut, schema)
    return out.select(F.when(F.col("k_id") != F.lit(NULL_ID), F.col("k_id")).alias("doc_id"), *names[1:])


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, input_ids, doc_ids): whole sequences from ``pack(..., with_ids=True)``.

    A sequence has at most ``length`` pieces.  It is padded to ``length`` unless
    its own length is a power of two.
    """
    def build(pdf):
        import pandas as pd
        pdf = pdf.sort_values("offset")
        ids = np.concatenate([np.frombuffer(x, dtype="<u2") for x in pdf["ids"]]).astype(np.int32)
        n = len(ids)
        if n & (n - 1):
            ids = np.concatenate([ids, np.full(length - n, pad_id, dtype=np.int32)])
        docs = [None if pd.isna(d) else int(d) for d in pdf["doc_id"]]
        return pd.DataFrame({"sequence_id": [int(pdf["sequence_id"].iloc[0])], "n_tokens": [n],
                             "input_ids": [ids.tolist()], "doc_ids": [docs]})

    return pieces.groupBy("sequence_id").applyInPandas(
        build, "sequence_id long, n_tokens long, input_ids array<int>, doc_ids array<long>")
