"""Fixed-size binary records: fvecs, ivecs and attribute files, as Spark data sources.

fvecs / ivecs: each record is an int32 dimension and as many float32 / int32.
attributes: uint64 rows, uint64 dimension, then float32 row by row.

Files are read in splits of whole records by any number of tasks, through pyarrow's file systems.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
KINDS = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int")}


def opened(path: str):
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


@dataclass
class Span(InputPartition):
    start: int
    stop: int


class RecordReader(DataSourceReader):
    """Rows (id, values) of records of equal size after a header."""

    def __init__(self, path: str, kind: str, names: tuple[str, str]):
        self.path, self.kind, self.names = path, kind, names
        with opened(path) as f:
            size = f.size()
            if kind == "attributes":
                if size < 16:
                    raise ValueError(f"{path} has no header")
                self.rows, self.dim = struct.unpack("<QQ", f.read(16))
                self.offset, self.record = 16, 4 * self.dim
            else:
                self.dim = struct.unpack("<i", f.read(4))[0] if size else 0
                self.offset, self.record = 0, 4 + 4 * self.dim
                self.rows = size // self.record if size else 0
            if self.rows and size != self.offset + self.rows * self.record:
                raise ValueError(f"{path} is cut off or has records of several dimensions")

    def partitions(self):
        step = max(1, SPLIT_BYTES // max(1, self.record))
        return [Span(a, min(a + step, self.rows)) for a in range(0, self.rows, step)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        for a in range(partition.start, partition.stop, 65536):
            n = min(65536, partition.stop - a)
            with opened(self.path) as f:
                f.seek(self.offset + a * self.record)
                raw = f.read(n * self.record)
            dtype = "<f4" if self.kind == "attributes" else KINDS[self.kind][0]
            values = np.frombuffer(raw, dtype).reshape(n, -1)
            if self.kind != "attributes":
                if (values[:, 0].view("<i4") != self.dim).any():
                    raise ValueError(f"{self.path} has records of several dimensions")
                values = np.ascontiguousarray(values[:, 1:])
            offsets = pa.array(np.arange(0, n * self.dim + 1, self.dim, dtype=np.int32)) if self.dim else pa.array(np.zeros(n + 1, np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n, dtype=np.int64)), lists], list(self.names))


class _Records(DataSource):
    kind, names, element = "", ("", ""), ""

    @classmethod
    def name(cls):
        return cls.kind

    def schema(self):
        return f"{self.names[0]} long, {self.names[1]} array<{self.element}>"

    def reader(self, schema):
        return RecordReader(self.options["path"], self.kind, self.names)


class Fvecs(_Records):
    kind, names, element = "fvecs", ("vec_id", "embedding"), "float"


class Ivecs(_Records):
    kind, names, element = "ivecs", ("qid", "ids"), "int"


class Attributes(_Records):
    kind, names, element = "attributes", ("vec_id", "meta"), "float"


def register(spark: SparkSession) -> None:
    """Make format("fvecs"), format("ivecs") and format("attributes") known to the session."""
    for source in (Fvecs, Ivecs, Attributes):
        spark.dataSource.register(source)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """vec_id and one column m0, m1, ... an axis: what Parquet statistics and pushdown work on."""
    register(spark)
    df = spark.read.format("attributes").load(path)
    with opened(path) as f:
        d = struct.unpack("<QQ", f.read(16))[1]
    return df.select("vec_id", *(F.col("meta")[i].alias(f"m{i}") for i in range(d)))


def attach(vectors: DataFrame, attributes: DataFrame) -> DataFrame:
    """Vectors with their attributes; an error if either side has rows that the other lacks."""
    out = vectors.join(attributes, "vec_id")
    n = [x.count() for x in (vectors, attributes, out)]
    if len(set(n)) > 1:
        raise ValueError(f"{n[0]} vectors, {n[1]} attribute points, {n[2]} in common")
    return out


def write_records(df: DataFrame, path: str, kind: str, id_col: str, value_cols: list[str] | str, dim: int) -> None:
    """One binary file of the rows in order of their ids.

    Tasks write parts of whole records to a folder beside the file; the driver then joins them, part by
    part in blocks, behind the header. Parts of attempts that did not count are not in the list.
    """
    value = F.col(value_cols) if isinstance(value_cols, str) else F.array(*value_cols)
    rows = df.select(F.col(id_col).cast("long").alias("id"), value.cast("array<int>" if kind == "ivecs" else "array<float>").alias("v"))
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    parts_dir = folder.split("://", 1)[-1] if "://" in path else folder
    store.create_dir(parts_dir, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        name, n = f"{folder}/{uuid.uuid4().hex}", 0
        out_store, out_path = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
        with out_store.open_output_stream(out_path) as out:
            for batch in batches:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False)
                if len(v) != batch.num_rows * dim:
                    raise ValueError(f"a row does not have {dim} values")
                v = v.astype("<i4" if kind == "ivecs" else "<f4").reshape(-1, dim)
                if kind != "attributes":
                    head = np.full((len(v), 1), dim, "<i4")
                    v = np.concatenate([head, v.view("<i4")], axis=1)
                out.write(np.ascontiguousarray(v).tobytes())
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([out_path]), pa.array([n])], ["part", "file", "n"])

    parts = rows.orderBy("id").mapInArrow(write, "part long, file string, n long").orderBy("part").collect()
    with store.open_output_stream(inner) as out:
        if kind == "attributes":
            out.write(struct.pack("<QQ", sum(p["n"] for p in parts), dim))
        for p in parts:
            with store.open_input_stream(p["file"]) as part:
                while block := part.read(8 << 20):
                    out.write(block)
    store.delete_dir(parts_dir)


def write_log(df: DataFrame, path: str, append: bool = False) -> None:
    """Result or timing lines as blank-separated text."""
    df.write.mode("append" if append else "overwrite").option("sep", " ").csv(path)


def log_index_time(spark: SparkSession, path: str, dataset: str, program: str, milliseconds: float) -> None:
    """Appends how long a build took."""
    write_log(spark.createDataFrame([(dataset, program, "index_time_sec:", milliseconds / 1000)], "dataset string, program string, what string, seconds double"), path, append=True)


def query_vectors(spark: SparkSession, vectors: list) -> DataFrame:
    """qid, qv of vectors held in numpy: each has one dimension, and all as many values."""
    rows = [np.asarray(v, np.float32) for v in vectors]
    if any(v.ndim != 1 for v in rows):
        raise ValueError("a query is a vector: an array of one dimension")
    if len({len(v) for v in rows}) > 1:
        raise ValueError("queries differ in length")
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "qid long, qv array<float>")
