"""Exact deduplication over a sharded cuckoo-filter index (operator 4).

A document's key is the SHA-256 of its text with A-Z lower-cased.  Keys are
dealt to shards by their leading digits.  Each shard is a cuckoo filter of
16-bit fingerprints beside a bucket of stored keys: a miss in the filter proves
a key new (no look at the bucket), a hit is verified against the full stored
key, and an insertion that finds no free slot doubles the filter and rebuilds
it from the stored keys.  Deleting a live key frees its slot.

``dedup`` is the one-pass job over a table; ``CuckooIndex`` keeps the shards as
Parquet in a folder all executors share and applies batches of insertions and
deletions to them.  Copies are combined before they move, so that a text that
makes up a third of all rows reaches its shard as a few rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, write_through
from .common import NULL_ID, join_groups, row_key, text_of

SLOTS = 4
MAX_KICKS = 200
MIN_SHARDS = 64
KEYS_PER_SHARD = 100_000
COMBINE_ROWS = 200_000


class CuckooFilter:
    """Cuckoo filter of 16-bit fingerprints, four slots a bucket; holds hex SHA-256 keys."""

    def __init__(self, capacity: int = 64, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(4, math.ceil(math.log2(max(1, capacity) / SLOTS / 0.85)))
            table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.table = [list(map(int, b)) for b in table]
        self.mask = len(self.table) - 1

    @staticmethod
    def _print(key: str) -> int:
        return (int(key[8:12], 16) or 1)

    def _spots(self, key: str) -> tuple[int, int, int]:
        f = self._print(key)
        i = int(key[16:28], 16) & self.mask
        return f, i, i ^ ((f * 0x5BD1E995) & self.mask)

    def contains(self, key: str) -> bool:
        f, i, j = self._spots(key)
        return f in self.table[i] or f in self.table[j]

    def insert(self, key: str) -> bool:
        """False if no slot could be freed; the table is then due for a rebuild."""
        f, i, j = self._spots(key)
        for b in (i, j):
            row = self.table[b]
            if 0 in row:
                row[row.index(0)] = f
                return True
        b = i
        for k in range(MAX_KICKS):
            row = self.table[b]
            s = (f + k) % SLOTS
            f, row[s] = row[s], f
            b ^= (f * 0x5BD1E995) & self.mask
            row = self.table[b]
            if 0 in row:
                row[row.index(0)] = f
                return True
        return False

    def delete(self, key: str) -> bool:
        """Frees one slot of a key; call it for live keys only."""
        f, i, j = self._spots(key)
        for b in (i, j):
            if f in self.table[b]:
                self.table[b][self.table[b].index(f)] = 0
                return True
        return False

    def to_bytes(self) -> bytes:
        return np.array(self.table, dtype="<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, dtype="<u2").reshape(-1, SLOTS))


class Shard:
    """A filter with its bucket of stored keys: key -> [largest id, rows, rows with that id]."""

    def __init__(self, raw: bytes | None = None, keys: dict | None = None):
        self.keys: dict[str, list] = keys or {}
        self.filter = CuckooFilter.from_bytes(raw) if raw else CuckooFilter()
        self.resizes = 0
        self.false_hits = 0

    def add(self, key: str, doc_id: int, n: int = 1, n_max: int = 1) -> bool:
        """Insert or merge; True if the key was new."""
        if self.filter.contains(key):
            old = self.keys.get(key)                 # verify the hit against the stored key
            if old is not None:
                if doc_id > old[0]:
                    old[0], old[2] = doc_id, n_max
                elif doc_id == old[0]:
                    old[2] += n_max
                old[1] += n
                return False
            self.false_hits += 1
        self.keys[key] = [doc_id, n, n_max]
        if not self.filter.insert(key):
            self.resize()
        return True

    def resize(self) -> None:
        """Double the filter and refill it from the stored keys."""
        size = 2 * SLOTS * len(self.filter.table)
        while True:
            self.resizes += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(k) for k in self.keys):
                return
            size *= 2

    def remove(self, key: str, n: int | None = None) -> bool:
        """Take ``n`` rows of a live key away (None: all of them); its slot is freed with the last one."""
        if not (self.filter.contains(key) and key in self.keys):
            return False
        row = self.keys[key]
        if n is not None and n < row[1]:
            row[1] -= n
            row[2] = min(row[2], row[1])
            return True
        del self.keys[key]
        self.filter.delete(key)
        return True


def digests(docs: DataFrame, n_shards_digits: int = 4) -> DataFrame:
    """(k_id, k_hash, key) per row; key is the hex SHA-256 of the text with A-Z lower-cased."""
    kid, kh = row_key(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = [hashlib.sha256(t.as_py().lower()).hexdigest() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key, pa.string())],
                                             ["k_id", "k_hash", "key"])

    return docs.select(kid.alias("k_id"), kh.alias("k_hash"), text_of(docs["text"]).cast("binary").alias("t")) \
        .mapInArrow(run, "k_id long, k_hash long, key string")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a task become one row; flushed every COMBINE_ROWS keys, so memory is bounded."""
    def out(d: dict) -> pa.RecordBatch:
        v = list(d.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(d), pa.string()), *(pa.array([x[i] for x in v], pa.int64()) for i in range(3))],
            ["key", "doc_id", "n", "n_max"])

    seen: dict[str, list] = {}
    for b in batches:
        for key, i in zip(b.column("key").to_pylist(), b.column("k_id").to_pylist()):
            old = seen.get(key)
            if old is None:
                seen[key] = [i, 1, 1]
            else:
                old[1] += 1
                if i > old[0]:
                    old[0], old[2] = i, 1
                elif i == old[0]:
                    old[2] += 1
        if len(seen) >= COMBINE_ROWS:
            yield out(seen)
            seen = {}
    if seen:
        yield out(seen)


def _shard_of(n_shards: int):
    return F.pmod(F.conv(F.substring("key", 1, 7), 16, 10).cast("long"), F.lit(n_shards)).cast("int")


def _dedup_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    s = Shard()
    for key, i, n, m in zip(pdf["key"], pdf["doc_id"], pdf["n"], pdf["n_max"]):
        s.add(key, int(i), int(n), int(m))
    v = list(s.keys.values())
    return pd.DataFrame({"key": list(s.keys), "keep": [x[0] for x in v], "group_size": [x[1] for x in v]})


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, k_id, k_hash.

    Of equal texts the row with the largest doc_id stays.  Null text counts as
    empty; a null id sorts below all others and comes back as null; of rows
    that repeat the kept row (same id and text) one is kept.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    rows = write_through(digests(docs), "cuckoo-digests")
    n = rows.count()
    shards = max(MIN_SHARDS, math.ceil(n / KEYS_PER_SHARD))
    groups = write_through(
        rows.mapInArrow(_combine, "key string, doc_id long, n long, n_max long")
            .withColumn("shard", _shard_of(shards)).groupBy("shard")
            .applyInPandas(_dedup_shard, "key string, keep long, group_size long"), "cuckoo-groups")
    j = join_groups(rows, groups, "key", "group_size", n)
    # Of rows that repeat the kept row one stays.
    w = Window.partitionBy("key", "k_id").orderBy("k_hash")
    both = j.withColumn("kept", (F.col("k_id") == F.col("keep")) & (F.row_number().over(w) == 1))
    real = lambda c: F.when(F.col(c) != F.lit(NULL_ID), F.col(c))
    return both.select(real("k_id").alias("doc_id"), real("keep").alias("keep_id"),
                       F.col("group_size").cast("long").alias("group_size"), "kept",
                       F.col("key").alias("text_sha256"), "k_id", "k_hash")


class CuckooIndex:
    """A stored index: ``insert``, ``delete`` and ``lookup`` batches of documents.

    Each batch writes a new generation of all shards (keys and filter images)
    under ``path``, then the object points at it; a failed job leaves the last
    generation as it was.  Opened on a path that holds an index, the object
    goes on with its newest finished generation and its number of shards.
    """

    SCHEMA = "shard int, filter binary, keys map<string, struct<keep: long, n: long, n_max: long>>"

    def __init__(self, spark: SparkSession, n_shards: int = MIN_SHARDS, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "cuckoo")
        stored = [self._stored(g) for g in self._generations()]
        if any(stored):
            # The newest finished generation; an unfinished one has no shard count yet.
            self.gen, self.n_shards = max(x for x in stored if x)
        else:
            self.gen, self.n_shards = 0, n_shards
            self._finish(spark.createDataFrame([], self.SCHEMA), 0)

    def _generations(self) -> list[int]:
        """Generations whose shards are written, in whatever store the path names."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return [int(x[5:]) for x in names if x.startswith("size=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]

    def _stored(self, gen: int) -> tuple[int, int] | None:
        row = self.spark.read.schema("n_shards int").parquet(f"{self.path}/size={gen}").first()
        return (gen, row.n_shards) if row else None

    def _finish(self, shards: DataFrame, gen: int) -> None:
        """Writes a generation, then its shard count, which makes it valid."""
        shards.write.mode("overwrite").parquet(f"{self.path}/gen={gen}")
        self.spark.createDataFrame([(self.n_shards,)], "n_shards int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/size={gen}")
        self.gen = gen

    def shards(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/gen={self.gen}")

    def _batch(self, docs: DataFrame) -> DataFrame:
        return digests(docs).mapInArrow(_combine, "key string, doc_id long, n long, n_max long") \
            .withColumn("shard", _shard_of(self.n_shards))

    def _apply(self, docs: DataFrame, action: str) -> None:
        def run(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            stored = {k: [int(v["keep"]), int(v["n"]), int(v["n_max"])]
                      for k, v in dict(old["keys"].iloc[0]).items()} if len(old) else {}
            s = Shard(old["filter"].iloc[0] if len(old) else None, stored)
            for k, i, n, m in zip(new["key"], new["doc_id"], new["n"], new["n_max"]):
                if action == "insert":
                    s.add(k, int(i), int(n), int(m))
                else:
                    s.remove(k, int(n))
            keys = {k: {"keep": v[0], "n": v[1], "n_max": v[2]} for k, v in s.keys.items()}
            return pd.DataFrame({"shard": [int(key[0])], "filter": [s.filter.to_bytes()], "keys": [keys]})

        out = self.shards().groupBy("shard").cogroup(self._batch(docs).groupBy("shard")).applyInPandas(run, self.SCHEMA)
        self._finish(out, self.gen + 1)

    def insert(self, docs: DataFrame) -> None:
        self._apply(docs, "insert")

    def delete(self, docs: DataFrame) -> None:
        """Take the rows of ``docs`` out of the index; a text is forgotten with its last row.

        Texts that the index doesn't hold are left alone.  The stored largest
        id of a text that still has rows is the largest that was inserted.
        """
        self._apply(docs, "delete")

    def lookup(self, docs: DataFrame) -> DataFrame:
        """(key, n, found) per distinct text of ``docs``: filter first, hits verified against the stored keys."""
        def run(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            s = Shard(old["filter"].iloc[0], dict(old["keys"].iloc[0])) if len(old) else Shard()
            new = new.groupby("key", as_index=False)["n"].sum()
            new["found"] = [s.filter.contains(k) and k in s.keys for k in new["key"]]
            return new

        return self.shards().groupBy("shard").cogroup(self._batch(docs).groupBy("shard")) \
            .applyInPandas(run, "key string, n long, found boolean")
