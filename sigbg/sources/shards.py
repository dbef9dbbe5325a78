"""Training-shard files in the TFRecord container (S7 sink, S8 source).

Implemented with Spark's Python Data Source API on Arrow batches: the writer
runs inside each task and starts a new file every ``RECORDS_PER_FILE`` records,
so that the reader - one input partition a file, since the container can't be
split - never meets a huge one.  Records hold a ``tf.train.Example`` with a
fixed-length float list ``features`` and a scalar ``labels``.

Records of one shape differ only in their float bytes, so a batch is encoded,
checksummed and decoded as a NumPy matrix; records of other shapes (other
writers, integer labels) go one by one.  A cut file, a wrong checksum, a record
of the wrong length or a field of a wrong type is an error, never a dropped row.

Container layout (public TFRecord format): little-endian uint64 length,
masked CRC-32C of the length bytes, payload, masked CRC-32C of the payload.
Paths must be on a filesystem every executor mounts; other stores are refused.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

RECORDS_PER_FILE = 1 << 17

# CRC-32C (Castagnoli), reflected polynomial; table generated from the rule.
_POLY = 0x82F63B78
_TABLE = []
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ _POLY if _c & 1 else _c >> 1
    _TABLE.append(_c)
_MASK_DELTA = 0xA282EAD8


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    t = _TABLE
    for b in data:
        c = t[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


_TABLE_NP = np.array(_TABLE, dtype=np.uint32)


def crc32c_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32C of every row of a byte matrix: one table step a column, for all rows at once."""
    c = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(rows.shape[1]):
        c = _TABLE_NP[(c ^ rows[:, j]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    return c ^ np.uint32(0xFFFFFFFF)


def mask_crc(c):
    """The container's mask of a checksum (a number or an array of them)."""
    if isinstance(c, np.ndarray):
        return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(_MASK_DELTA)
    return (((c >> 15) | (c << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def masked_crc(data: bytes) -> int:
    return mask_crc(crc32c(data))


# ----------------------------------------------------------- protobuf bits

def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        b = n & 0x7F
        n >>= 7
        if n:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def _field(num: int, payload: bytes) -> bytes:
    return _varint((num << 3) | 2) + _varint(len(payload)) + payload


def _float_feature(values) -> bytes:
    packed = struct.pack(f"<{len(values)}f", *values)
    float_list = _field(1, packed)            # FloatList.value (packed)
    return _field(2, float_list)              # Feature.float_list


def encode_example(features: dict[str, list[float]]) -> bytes:
    entries = b""
    for key, vals in features.items():
        entry = _field(1, key.encode()) + _field(2, _float_feature(vals))
        entries += _field(1, entry)           # Features.feature (map entry)
    return _field(1, entries)                 # Example.features


def _read_varint(buf: bytes, i: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        b = buf[i]
        i += 1
        n |= (b & 0x7F) << shift
        if not b & 0x80:
            return n, i
        shift += 7


def _fields(buf: bytes):
    i = 0
    while i < len(buf):
        key, i = _read_varint(buf, i)
        wt = key & 7
        if wt == 2:
            ln, i = _read_varint(buf, i)
            yield key >> 3, buf[i:i + ln]
            i += ln
        elif wt == 0:
            _, i = _read_varint(buf, i)
        elif wt == 5:
            yield key >> 3, buf[i:i + 4]
            i += 4
        elif wt == 1:
            i += 8
        else:
            raise ValueError("unsupported wire type")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _numbers(kind: int, buf: bytes) -> list:
    """Values of a FloatList (kind 2) or Int64List (kind 3), packed or not."""
    out, i = [], 0
    while i < len(buf):
        key, i = _read_varint(buf, i)
        wire = key & 7
        if key >> 3 != 1:
            raise ValueError("unknown field in a value list")
        if wire == 2:
            n, i = _read_varint(buf, i)
            part, i = buf[i:i + n], i + n
            if kind == 2:
                out += struct.unpack(f"<{n // 4}f", part)
            else:
                j = 0
                while j < n:
                    v, j = _read_varint(part, j)
                    out.append(_signed(v))
        elif wire == 5 and kind == 2:
            out += struct.unpack("<f", buf[i:i + 4])
            i += 4
        elif wire == 0 and kind == 3:
            v, i = _read_varint(buf, i)
            out.append(_signed(v))
        else:
            raise ValueError("a value list of a wrong type")
    return out


def decode_example(buf: bytes) -> dict[str, list]:
    """Names to lists of floats or integers; a list of bytes raises ValueError."""
    out: dict[str, list] = {}
    for f, features in _fields(buf):
        if f != 1:
            continue
        for g, entry in _fields(features):
            if g != 1:
                continue
            key, feat = None, b""
            for h, v in _fields(entry):
                if h == 1:
                    key = v.decode()
                elif h == 2:
                    feat = v
            vals: list = []
            for k, lst in _fields(feat):
                if k not in (2, 3):
                    raise ValueError(f"field {key!r} holds bytes, not numbers")
                vals += _numbers(k, lst)
            out[key] = vals
    return out


def _frame(payload: np.ndarray) -> bytes:
    """Container records of a matrix of payloads of one length."""
    n, size = payload.shape
    head = struct.pack("<Q", size)
    out = np.empty((n, size + 16), dtype=np.uint8)
    out[:, :8] = np.frombuffer(head, np.uint8)
    out[:, 8:12] = np.frombuffer(struct.pack("<I", masked_crc(head)), np.uint8)
    out[:, 12:-4] = payload
    out[:, -4:] = mask_crc(crc32c_rows(payload)).astype("<u4").view(np.uint8).reshape(n, 4)
    return out.tobytes()


def encode_rows(features: np.ndarray, labels: np.ndarray | None) -> bytes:
    """Records of a float32 matrix and its labels (None: records without a label)."""
    n, d = features.shape
    shape = {"features": [0.0] * d} | ({} if labels is None else {"labels": [0.0]})
    blank = np.frombuffer(encode_example(shape), np.uint8)
    rows = np.repeat(blank[None, :], n, axis=0)
    at = _float_places(d, labels is not None)
    if d:
        rows[:, at["features"]:at["features"] + 4 * d] = np.ascontiguousarray(features, "<f4").view(np.uint8).reshape(n, 4 * d)
    if labels is not None:
        rows[:, at["labels"]:at["labels"] + 4] = np.ascontiguousarray(labels, "<f4").view(np.uint8).reshape(n, 4)
    return _frame(rows)


def _float_places(d: int, with_label: bool) -> dict[str, int]:
    """Where the float bytes of a record of this shape begin."""
    one = struct.pack("<f", 1.5)
    zero = {"features": [0.0] * d} | ({"labels": [0.0]} if with_label else {})
    at = {}
    for name, vals in zero.items():
        if vals:
            a, b = encode_example(zero), encode_example(zero | {name: [1.5] * len(vals)})
            # The first float: the payloads differ there first, by its non-zero bytes.
            first = next(i for i in range(len(a)) if a[i] != b[i])
            at[name] = first - next(i for i in range(4) if one[i])
    return at


def _split(data: bytes, path: str) -> list[bytes]:
    """Payloads of a file whose records differ in length, checked one by one."""
    out, i = [], 0
    while i < len(data):
        if i + 12 > len(data):
            raise ValueError(f"{path} ends inside a record's header")
        (n,) = struct.unpack_from("<Q", data, i)
        if struct.unpack_from("<I", data, i + 8)[0] != masked_crc(data[i:i + 8]):
            raise ValueError(f"corrupt length in {path}")
        if i + 16 + n > len(data):
            raise ValueError(f"{path} ends inside a record")
        body = data[i + 12:i + 12 + n]
        if struct.unpack_from("<I", data, i + 12 + n)[0] != masked_crc(body):
            raise ValueError(f"corrupt record in {path}")
        out.append(body)
        i += 16 + n
    return out


def _one(body: bytes, path: str) -> tuple[list, float | None]:
    ex = decode_example(body)
    label = ex.get("labels") or []
    if len(label) > 1:
        raise ValueError(f"a record of {path} has {len(label)} labels")
    return ex.get("features", []), float(label[0]) if label else None


def decode_file(data: bytes, path: str = "shard") -> pa.RecordBatch:
    """(features, labels) of a file's records, in order."""
    names = ["features", "labels"]
    kind = [pa.list_(pa.float32()), pa.float32()]
    if not data:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in kind], names)
    if len(data) >= 12:
        (n,) = struct.unpack_from("<Q", data)
        if n < len(data) and len(data) % (n + 16) == 0:
            rows = np.frombuffer(data, np.uint8).reshape(-1, n + 16)
            features, label = _one(data[12:12 + n], path)
            d = len(features)
            blank = encode_example({"features": [0.0] * d} | ({} if label is None else {"labels": [0.0]}))
            floats = np.zeros(len(blank), dtype=bool)
            at = _float_places(d, label is not None)
            for name, size in (("features", 4 * d), ("labels", 4)):
                if name in at:
                    floats[at[name]:at[name] + size] = True
            body = rows[:, 12:-4]
            if len(blank) == n and (rows[:, :8] == rows[0, :8]).all() and (body[:, ~floats] == np.frombuffer(blank, np.uint8)[~floats]).all():
                want = struct.pack("<I", masked_crc(data[:8]))
                if (rows[:, 8:12] != np.frombuffer(want, np.uint8)).any():
                    raise ValueError(f"corrupt length in {path}")
                crc = np.ascontiguousarray(rows[:, -4:]).view("<u4").ravel()
                if (crc != mask_crc(crc32c_rows(body))).any():
                    raise ValueError(f"corrupt record in {path}")
                f = np.ascontiguousarray(body[:, at["features"]:at["features"] + 4 * d]).view("<f4").ravel() if d else np.zeros(0, "<f4")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * d), pa.array(f, pa.float32()))
                y = pa.array(np.ascontiguousarray(body[:, at["labels"]:at["labels"] + 4]).view("<f4").ravel(), pa.float32()) \
                    if label is not None else pa.nulls(len(rows), pa.float32())
                return pa.RecordBatch.from_arrays([lists, y], names)
    pairs = [_one(x, path) for x in _split(data, path)]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], t) for i, t in enumerate(kind)], names)


# ------------------------------------------------------------ data source

@dataclass
class _Commit(WriterCommitMessage):
    paths: list
    count: int


def _local(path: str) -> str:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path) and not path.startswith("file:"):
        raise ValueError(f"shards need a mounted filesystem, not {path.split(':')[0]}: copy them there or mount the store")
    return re.sub(r"^file:(//)?", "", path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = _local(options["path"])
        self.per_file = int(options.get("recordsPerFile", RECORDS_PER_FILE))
        self.job = uuid.uuid4().hex[:12]
        self.overwrite = overwrite

    def write(self, iterator):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        task, attempt = (ctx.partitionId(), ctx.taskAttemptId()) if ctx else (0, 0)
        os.makedirs(self.path, exist_ok=True)
        done, room, fh, tmp, total = [], 0, None, "", 0

        def close():
            if fh is not None:
                fh.close()
                os.replace(tmp, tmp.removesuffix(".inprogress"))
                done.append(tmp.removesuffix(".inprogress"))

        for batch in iterator:
            i = 0
            while i < len(batch):
                if not room:
                    close()
                    tmp = os.path.join(self.path, f"part-{task:05d}-{len(done):05d}-{self.job}-{attempt}.tfrecord.inprogress")
                    fh, room = open(tmp, "wb"), self.per_file
                part = batch.slice(i, min(room, len(batch) - i))
                for raw in _encoded(part):
                    fh.write(raw)
                i, room, total = i + len(part), room - len(part), total + len(part)
        close()
        return _Commit(done, total)

    def commit(self, messages):
        # A task re-run after an executor loss may have left files of a failed
        # attempt: keep only those of the committed attempts.  An overwrite
        # takes the older files away once the new ones are all there.
        keep = {p for m in messages if m is not None for p in m.paths}
        for f in glob.glob(os.path.join(self.path, "part-*" if self.overwrite else f"part-*-{self.job}-*")):
            if f not in keep:
                os.remove(f)

    def abort(self, messages):
        for f in glob.glob(os.path.join(self.path, f"part-*-{self.job}-*")):
            os.remove(f)


def _encoded(batch: pa.RecordBatch):
    """Records of a batch: runs of rows of one shape (number of features, label there or not) at a time."""
    lists, labels = batch.column("features"), batch.column("labels")
    size = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], dtype=np.int64)
    there = np.array(labels.is_valid())
    shape = size * 2 + there
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4")
    y = labels.fill_null(0).to_numpy(zero_copy_only=False).astype("<f4")
    start = np.cumsum(size) - size
    edge = np.concatenate([[0], np.flatnonzero(np.diff(shape)) + 1, [len(batch)]])
    for a, b in zip(edge[:-1], edge[1:]):
        if a < b:
            d = int(size[a])
            yield encode_rows(flat[start[a]:start[a] + d * (b - a)].reshape(b - a, d), y[a:b] if there[a] else None)


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = _local(options["path"])

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, "part*")))
        return [_Part(f) for f in files if not f.endswith(".inprogress")]

    def read(self, partition):
        with open(partition.path, "rb") as fh:
            batch = decode_file(fh.read(), partition.path)
        for i in range(0, len(batch), 10_000):
            yield batch.slice(i, 10_000)


class TFRecordSource(DataSource):
    """``df.write.format("tfrecord").save(p)`` / ``spark.read.format("tfrecord").load(p)``."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return "features array<float>, labels float"

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, overwrite)

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    from ..session import ship_package
    ship_package(spark)
    spark.dataSource.register(TFRecordSource)


def read_shards(spark, path: str, n_features: int, label_type: str = "float"):
    """Shards -> (features, labels); a record of another length is an error, a missing label 0."""
    from pyspark.sql import functions as F
    register(spark)
    df = spark.read.format("tfrecord").load(path)
    wrong = F.raise_error(F.concat(F.lit(f"a record has not {n_features} features but "), F.size("features").cast("string")))
    return df.select(F.when(F.size("features") == n_features, F.col("features")).otherwise(wrong.cast("array<float>")).alias("features"),
                     F.coalesce(F.col("labels"), F.lit(0.0).cast("float")).cast(label_type).alias("labels"))


def write_shards(df, path: str, mode: str = "append", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Shard files of at most ``records_per_file`` records, from each partition; integer labels become floats."""
    from pyspark.sql import functions as F
    register(df.sparkSession)
    df.select(F.col("features").cast("array<float>").alias("features"), F.col("labels").cast("float").alias("labels")) \
        .write.format("tfrecord").mode(mode).option("recordsPerFile", records_per_file).save(path)
