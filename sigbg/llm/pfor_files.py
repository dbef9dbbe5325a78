"""Token files of patched frame-of-reference blocks (operator 2).

A file image holds a run of the token stream: a header, the start of every
block, then the blocks.  A block of up to ``BLOCK`` ids stores its minimum, the
bit width that covers the ``PERCENT`` smallest offsets from it, the offsets'
low bits packed at that width, and an exception list (place, high bits) for the
others.  Fixed layout, little-endian:

    image  b"PFR1", u32 ids, u32 blocks, u32 start[blocks + 1], blocks
    block  u32 minimum, u16 count, u8 width, u8 0, u16 exceptions, packed bits,
           u16 place[exceptions], u32 high[exceptions]

Images are stored by Spark's own writer as rows of a Parquet table (run, first
token in the run, image, the documents' ids and lengths), so that half-written
output of lost tasks never shows and any shared file system will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import NULL_ID, text_of
from .token_store import batches_of, map_runs, with_offsets
from .tokens import END_ID, Encoder, tokenizer_path

BLOCK = 1024
PERCENT = 95
IMAGE_IDS = 1 << 20
MAGIC = b"PFR1"
_HEAD = struct.Struct("<IHBBH")


def encode_block(ids: np.ndarray, percent: float = PERCENT) -> bytes:
    """One block from up to 65,535 ids (uint32)."""
    low = int(ids.min())
    off = ids.astype(np.uint32) - np.uint32(low)
    width = int(np.partition(off, k := min(len(off) - 1, int(len(off) * percent / 100)))[k]).bit_length()
    rest = off >> np.uint32(width) if width < 32 else np.zeros_like(off)
    at = np.flatnonzero(rest)
    bits = b""
    if width:
        raw = (off & np.uint32((1 << width) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)
        bits = np.packbits(np.unpackbits(raw, axis=1, count=width, bitorder="little").ravel(), bitorder="little").tobytes()
    return _HEAD.pack(low, len(ids), width, 0, len(at)) + bits + at.astype("<u2").tobytes() + rest[at].astype("<u4").tobytes()


def decode_block(raw: bytes | memoryview) -> np.ndarray:
    low, count, width, _, n_exc = _HEAD.unpack_from(raw, 0)
    at = _HEAD.size
    off = np.zeros(count, dtype=np.uint32)
    if width:
        size = (count * width + 7) // 8
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=count * width, bitorder="little")
        full = np.zeros((count, 32), dtype=np.uint8)
        full[:, :width] = bits.reshape(count, width)
        off = np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
        at += size
    if n_exc:
        place = np.frombuffer(raw, "<u2", n_exc, at)
        off[place] |= np.frombuffer(raw, "<u4", n_exc, at + 2 * n_exc) << np.uint32(width)
    return off + np.uint32(low)


def encode_image(ids: np.ndarray, block: int = BLOCK, percent: float = PERCENT) -> bytes:
    """A file image of ids (uint32)."""
    blocks = [encode_block(ids[i:i + block], percent) for i in range(0, len(ids), block)]
    head = 12 + 4 * (len(blocks) + 1)
    starts = head + np.cumsum([0] + [len(b) for b in blocks])
    return MAGIC + struct.pack("<II", len(ids), len(blocks)) + starts.astype("<u4").tobytes() + b"".join(blocks)


def decode_image(raw: bytes, first: int = 0, last: int | None = None, block: int = BLOCK) -> np.ndarray:
    """Ids [first, last) of an image; only the blocks that hold them are decoded."""
    if raw[:4] != MAGIC:
        raise ValueError("not a PFR1 image")
    n, blocks = struct.unpack_from("<II", raw, 4)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, dtype=np.uint32)
    starts = np.frombuffer(raw, "<u4", blocks + 1, 12)
    view, b0, b1 = memoryview(raw), first // block, (last - 1) // block
    ids = np.concatenate([decode_block(view[starts[i]:starts[i + 1]]) for i in range(b0, b1 + 1)])
    return ids[first - b0 * block:last - b0 * block]


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Tokenize whole texts and write their ids as images under ``path``, in ascending doc_id order."""
    tokenizer = tokenizer or tokenizer_path()

    def task(run: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = Encoder.of(tokenizer), np.array([END_ID], dtype="<u2").tobytes()
        names = ["run", "in_run", "n_ids", "image", "doc_ids", "doc_tokens"]
        at, size, ids, who, count = 0, 0, [], [], []

        def image() -> pa.RecordBatch:
            raw = encode_image(np.frombuffer(b"".join(ids), dtype="<u2").astype(np.uint32))
            return pa.RecordBatch.from_arrays(
                [pa.array([run], pa.int32()), pa.array([at], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([raw], pa.binary()), pa.array([who], pa.list_(pa.int64())),
                 pa.array([count], pa.list_(pa.int64()))], names)

        for b in batches:
            for first, part in batches_of(b.column(1).to_pylist()):
                for i, x in enumerate(enc.ids(part)):
                    ids.append(x + end)
                    who.append(b.column(0)[first + i].as_py())
                    count.append(len(x) // 2 + 1)
                    size += count[-1]
                    if size >= IMAGE_IDS:
                        yield image()
                        at, size, ids, who, count = at + size, 0, [], [], []
        if who:
            yield image()

    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("k_id"),
                       text_of(docs["text"]).cast("binary").alias("t")) \
        .repartitionByRange("k_id").sortWithinPartitions("k_id", "t")
    map_runs(rows, task, "run int, in_run long, n_ids long, image binary, doc_ids array<long>, doc_tokens array<long>") \
        .write.mode("overwrite").parquet(path)


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, uint32 bytes, ``with_ids``) decoded from the files."""
    files = with_offsets(spark.read.parquet(path), "run", "n_ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, who, count, before in zip(b.column(0), b.column(1), b.column(2), b.column(3).to_pylist()):
                ids = decode_image(raw.as_py())
                n = np.array(count.as_py(), dtype=np.int64)
                cut = np.cumsum(n) - n
                parts = [ids[i:i + k].astype("<u4").tobytes() for i, k in zip(cut, n)]
                cols = [pa.array(who.as_py(), pa.int64()), pa.array(before + cut), pa.array(n),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(parts, pa.binary())] if with_ids else []), names)

    names = ["k_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names)
    out = files.select("image", "doc_ids", "doc_tokens", (F.col("run_start") + F.col("in_run")).alias("before")) \
        .mapInArrow(decode, schema)
    return out.select(F.when(F.col("k_id") != F.lit(NULL_ID), F.col("k_id")).alias("doc_id"), *names[1:])


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back.

    Null text counts as empty (its end id alone); a null id sorts first and
    comes back null; repeated rows are stored each, rows of one id in order of
    their texts.  An empty table gives files without images.  Other columns
    are ignored.
    """
    path = scratch_path(docs.sparkSession, "pfor")
    write_files(docs, path, tokenizer)
    return read_files(docs.sparkSession, path)
