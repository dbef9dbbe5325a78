"""Repeated passages by content-defined chunking with a gear rolling hash (operator 3).

Texts are read as words (A-Z lower-cased, split at ASCII white space).  A gear
hash runs over the bytes; of any ``AMONG`` adjoining words, the one with the
smallest hash of the last ``WINDOW`` bytes at its end (the last of equals) is a boundary, so
boundaries move with the text, an insertion only disturbs what it touches, and
a passage has the same ones in every document from its first ``AMONG`` words
on.  A chunk begins at every boundary and
ends at the first boundary at least ``MIN_WORDS`` words on.  Chunks are
deduplicated by their 64-bit digests; a chunk whose digest occurs under two
document ids is repeated, and adjoining or overlapping repeated chunks of a
document make one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .common import NULL_ID, row_key, text_of

WINDOW = 16
AMONG = 4
MIN_WORDS = 16
MIN_PASSAGE = 24
GEAR = np.random.default_rng(5).integers(0, 1 << WINDOW, 256, dtype=np.uint32)
OUT_ROWS = 50_000


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] modulo 2**WINDOW, that is a hash of the last WINDOW bytes."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h & np.uint32((1 << WINDOW) - 1)


def chunks_of(text: bytes) -> tuple[np.ndarray, list[int]]:
    """(first and end word of each chunk, its digest) of a text."""
    words = text.lower().split()
    n = len(words)
    if n < MIN_WORDS:
        return np.zeros((0, 2), dtype=np.int64), []
    flat = b" ".join(words)
    data = np.frombuffer(flat, dtype=np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))            # the byte after each word
    h = gear_hashes(data)[ends[:-1] - 1]
    near = np.lib.stride_tricks.sliding_window_view(h, AMONG)[:, ::-1]
    pick = np.argmin(near, axis=1)
    cut = np.arange(len(near)) + AMONG - pick                          # a chunk may begin at these words
    cut = np.unique(np.concatenate([[0], cut, [n]]))
    start = cut[:-1]
    at = np.searchsorted(cut, start + MIN_WORDS)
    start, end = start[at < len(cut)], cut[at[at < len(cut)]]
    first = np.concatenate([[0], ends[:-1] + 1])[start]
    view = memoryview(flat)
    return np.stack([start, end], axis=1), [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), ends[end - 1].tolist())]


def chunk_table(docs: DataFrame) -> DataFrame:
    """(k_id, k_hash, place, digest): every chunk; place holds its first word and number of words."""
    kid, kh = row_key(docs)
    names = ["k_id", "k_hash", "place", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, places, digests, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, hashes, places)]
                                              + [pa.array(np.array(digests, dtype=np.uint64).view(np.int64))], names)

        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                place, digest = chunks_of(t.as_py())
                if not digest:
                    continue
                ids.append(np.full(len(digest), i, dtype=np.int64))
                hashes.append(np.full(len(digest), h, dtype=np.int64))
                places.append((place[:, 0] << 20) | np.minimum(place[:, 1] - place[:, 0], (1 << 20) - 1))
                digests += digest
                size += len(digest)
                if size >= OUT_ROWS:
                    yield out()
                    ids, hashes, places, digests, size = [], [], [], [], 0
        if size:
            yield out()

    return docs.select(kid.alias("k_id"), kh.alias("k_hash"), text_of(docs["text"]).cast("binary").alias("t")) \
        .mapInArrow(run, "k_id long, k_hash long, place long, digest long")


def passages(docs: DataFrame, min_words: int = MIN_PASSAGE) -> DataFrame:
    """Passages of at least ``min_words`` words that repeat in another document.

    One row per passage, or per piece of it that is kept or dropped alike:
    doc_id, start_word, n_words, n_chunks (that reach into it), first_doc_id
    (smallest id that holds one of these), kept, k_id, k_hash.  Each chunk
    belongs to the smallest id that holds it; a word is dropped if a chunk over
    it belongs to an earlier document, and so, from chunk to chunk, stays in
    one.  Kept rests of under ``min_words`` words have no row.  Documents without a repeated passage have no row.
    Null and empty texts have no chunks; repeated rows of one id don't make
    each other repeated; a null id sorts below all others and comes back null.
    An empty table gives an empty result; other columns are ignored.
    """
    chunks = chunk_table(docs)
    repeated = chunks.groupBy("digest").agg(F.min("k_id").alias("first"), F.max("k_id").alias("last")) \
        .filter("first < last").select("digest", "first")
    hits = chunks.join(write_through(repeated, "chunk-repeats"), "digest") \
        .select("k_id", "k_hash", F.shiftright("place", 20).alias("start"),
                (F.shiftright("place", 20) + F.col("place").bitwiseAND(F.lit((1 << 20) - 1))).alias("end"), "first")
    w = Window.partitionBy("k_id", "k_hash").orderBy("start")
    one = hits.withColumn("before", F.lag("start").over(w)).filter("before IS NULL OR before < start")   # identical rows count once
    one = one.withColumn("kept", F.col("first") == F.col("k_id"))
    # Chunks end in the order in which they begin, so the row before has the largest end so far.
    end_before, kept_before = F.lag("end").over(w), F.lag("kept").over(w)
    new_part = F.coalesce(F.col("start") > end_before, F.lit(True))
    runs = one.withColumn("new_part", new_part.cast("int")).withColumn("new_piece", (new_part | (F.col("kept") != kept_before)).cast("int"))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("part", F.sum("new_part").over(so_far)).withColumn("piece", F.sum("new_piece").over(so_far))
    pieces = runs.groupBy("k_id", "k_hash", "part", "piece").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), F.count(F.lit(1)).alias("n_chunks"), F.min("first").alias("first"),
        F.first("kept").alias("kept"))
    # Kept and dropped pieces take turns in a part; kept ones end where a dropped one begins.
    part = Window.partitionBy("k_id", "k_hash", "part")
    turn = part.orderBy("piece")
    pieces = pieces.withColumn("all_words", F.max("e").over(part) - F.min("s").over(part)) \
        .withColumn("e_before", F.lag("e").over(turn)).withColumn("s_after", F.lead("s").over(turn)) \
        .withColumn("s", F.when(F.col("kept"), F.greatest("s", "e_before")).otherwise(F.col("s"))) \
        .withColumn("e", F.when(F.col("kept"), F.least("e", "s_after")).otherwise(F.col("e"))) \
        .filter(F.col("e") > F.col("s"))
    pieces = pieces.withColumn("new", F.coalesce(F.lag("kept").over(turn) != F.col("kept"), F.lit(True)).cast("int")) \
        .withColumn("run", F.sum("new").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = pieces.groupBy("k_id", "k_hash", "part", "run", "kept", "all_words").agg(
        F.min("s").alias("start_word"), F.max("e").alias("e"), F.sum("n_chunks").alias("n_chunks"), F.min("first").alias("first")) \
        .filter((F.col("all_words") >= min_words) & (~F.col("kept") | (F.col("e") - F.col("start_word") >= min_words)))
    real = lambda c: F.when(F.col(c) != F.lit(NULL_ID), F.col(c))
    return spans.select(real("k_id").alias("doc_id"), "start_word", (F.col("e") - F.col("start_word")).alias("n_words"), "n_chunks",
                        real("first").alias("first_doc_id"), "kept", "k_id", "k_hash")


def remove_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the words of passages that aren't kept taken out of the text; other columns as they were.

    Documents without such passages keep their text untouched; in the others
    the remaining words are joined by one space.
    """
    cut = found.filter("NOT kept").groupBy("k_id", "k_hash") \
        .agg(F.collect_list(F.struct("start_word", "n_words")).alias("cut"))
    kid, kh = row_key(docs)
    cols = docs.columns
    j = docs.select(kid.alias("k_id"), kh.alias("k_hash"),
                    F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(cols)]).alias("row")) \
        .join(cut, ["k_id", "k_hash"], "left")
    t = f"c{cols.index('text')}"
    word = F.filter(F.split(F.col("row")[t], r"[\x20\x09-\x0D]+"), lambda x: x != "")
    left = F.filter(F.transform(word, lambda x, i: F.when(
        ~F.exists("cut", lambda c: (i >= c["start_word"]) & (i < c["start_word"] + c["n_words"])), x)), lambda x: x.isNotNull())
    text = F.when(F.col("cut").isNull(), F.col("row")[t]).otherwise(F.array_join(left, " "))
    return j.select(*[(text if c == "text" else F.col("row")[f"c{i}"]).alias(c) for i, c in enumerate(cols)])
