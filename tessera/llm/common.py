"""Helpers shared by the training-data operators: folders, Arrow slicing, word hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIPPED: set[str] = set()
#: Masters whose executors are threads of the driver.
LOCAL = re.compile(r"local(\[[^\]]*\])?")


def ship_code(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application.

    Nothing is done where PYTHONPATH already holds the package's folder.
    """
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp()) / "tessera_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (root / "tessera").rglob("*.py"):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and the executors are threads of the driver (tests, notebooks) a temporary folder
    takes its place; on a cluster that would be lost data, so there an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not LOCAL.fullmatch(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own, not yet made, for one run of an operator."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """Tables written inside go to one folder, which is deleted at the end: nothing that is read later
    may depend on them."""
    folder = shared_dir(spark, name)
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    within = _SCRATCH.get()
    path = f"{within}/{name}-{uuid.uuid4().hex}" if within else shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key in more than one of so many rows is hot: there are no more such keys, so they can be broadcast.
HOT_SHARE = 4096
LEAST_HOT = 500


def hot_keys(counted: DataFrame, count: str = "n") -> DataFrame:
    """The rows of `counted`, a written table of keys and their counts, whose keys are hot: HOT_SHARE at most."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    return counted.where(F.col(count) > max(LEAST_HOT, total // HOT_SHARE))


def with_hot(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """`rows` with the other columns of `values` (one row a key): rows of hot keys, of which there are a bounded
    number, by broadcast, all others by a shuffle."""
    keys = F.broadcast(hot.select(key))
    some = rows.join(keys, key, "left_semi").join(F.broadcast(values.join(keys, key, "left_semi")), key)
    return rows.join(keys, key, "left_anti").join(values.join(keys, key, "left_anti"), key).unionByName(some)


def give_back() -> None:
    """Hands the memory that this process has freed back to the system; the driver calls it after large steps of its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc: freed memory stays with the process
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def byte_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls; offsets start at 0."""
    array = array.cast(pa.large_binary())
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


# The finaliser of splitmix64 and its increment.
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
GOLDEN = 0x9E3779B97F4A7C15
LONG_SEGMENT = 256
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    upper = (raw >= 65) & (raw <= 90)
    return raw + (upper.astype(np.uint8) << 5)


def segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges, none empty, in order and apart from each other, as an Arrow array."""
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts] = 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    offsets = np.append(0, np.cumsum(ends - starts, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])


def distinct_segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each byte range among the distinct ones, and these: told apart by their bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    coded = segments(raw, starts, ends).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def hashes_128(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit XXH3 hash of each byte range."""
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(data[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())])
    both = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


def segment_hashes_128(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, halves: int = 2) -> tuple[np.ndarray, ...]:
    """Two 64-bit hashes of each byte range, independent of each other (or the first of them).

    Ranges are read eight bytes at a time, each eight mixed into the state before the next; those of
    more than LONG_SEGMENT bytes are hashed one by one.
    """
    padded = np.append(raw, np.zeros(16, np.uint8))
    eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))
    length = ends - starts
    out = [length.astype(np.uint64) * np.uint64(k) for k in (GOLDEN, MIX_2)][:halves]
    some, at, left = np.arange(len(starts)), starts, np.where(length > LONG_SEGMENT, 0, length)
    while len(some):
        more = left > 0
        if not more.all():
            some, at, left = some[more], at[more], left[more]
        part = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        out[0][some] = mix64(out[0][some] ^ part)
        if halves > 1:
            out[1][some] = mix64((out[1][some] + np.uint64(MIX_1)) ^ (part * np.uint64(GOLDEN)))
        at, left = at + 8, left - 8
    long = np.flatnonzero(length > LONG_SEGMENT)
    for i in long.tolist():
        digest = xxhash.xxh3_128_intdigest(raw[starts[i] : ends[i]])
        for h, shift in zip(out, (0, 64)):
            h[i] = digest >> shift & (1 << 64) - 1
    return tuple(out)


def segment_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return segment_hashes_128(raw, starts, ends, 1)[0]


def words_of(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None):
    """Words `[^\\x20\\x09-\\x0D]+` of each text: (starts, ends, first word of each text and the end)."""
    if space is None:
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    word = ~space
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = word[firsts]
    stops = np.zeros(len(raw) + 1, bool)
    stops[1:] = word
    stops[1:-1] &= ~word[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]]
    stops[lasts] = word[lasts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def schema_of(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)
