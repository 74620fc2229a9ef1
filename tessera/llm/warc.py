"""WARC archives whose records are compressed one by one against a dictionary in the file itself.

An archive (`.warc.zst`) begins with a skippable Zstandard frame that holds a dictionary built from
the archive's own first records; after it stands a frame for each record, so that any record can be
read alone. Records with equal payloads are written once, as `response`, by the row with the
largest page_id; the others are `revisit` records without a payload.

Archives are written by the executors to a folder that all of them share, under names that no other
task attempt uses; the manifest that the write returns lists the archives of the attempts that
counted, so a lost executor leaves at most files that nobody reads.

Defined results: null html is the empty payload; a null url leaves out the target URI; a null
page_id never wins: its record revisits the payload's largest id, and if all ids of a payload are null
its records are all responses; rows that repeat the winning page_id and payload are responses too; an empty table gives
an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, partitions, shared_dir, ship_code, written

# Magic numbers of the Zstandard format.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = struct.pack("<I", 0xEC30A437)

MANIFEST = "archive string, n_records long, n_bytes long, dictionary_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record. Page ids and the payload's full length stand in headers of our own."""
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_id(row['page_id'], digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {row['url'].replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    body = b""
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(row['winner'], digest)}")
        lines.append(f"X-Refers-To-Page-ID: {row['winner']}")
    else:
        body = row["html"].encode()
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def build_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; where the samples are too few to train on, their own bytes."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 16 * size:
        try:
            return zstandard.train_dictionary(size, samples)
        except zstandard.ZstdError:
            pass
    raw = b"".join(samples)[-size:].ljust(8, b" ")
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def load_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if raw.startswith(DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind)


class ArchiveWriter:
    """Writes archives of about `target` bytes of records into a folder, one after another."""

    def __init__(self, folder: str, target: int, sample: int, dictionary: int, level: int):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.target, self.sample, self.dictionary, self.level = target, sample, dictionary, level
        self.reset()

    def reset(self):
        self.pending, self.size, self.records, self.out, self.raw = [], 0, 0, None, 0

    def open(self):
        built = build_dictionary(self.pending, self.dictionary)
        raw = built.as_bytes()
        self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(self.name)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.size, self.dict_bytes = 8 + len(raw), len(raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=built, write_content_size=True)
        for record in self.pending:
            self.write(record)
        self.pending = []

    def write(self, record: bytes):
        frame = self.compressor.compress(record)
        self.out.write(frame)
        self.size += len(frame)

    def add(self, record: bytes):
        self.raw += len(record)
        self.records += 1
        if self.out is None:
            self.pending.append(record)
            if self.raw >= self.sample:
                self.open()
        else:
            self.write(record)
        return self.close() if self.raw >= self.target else None

    def close(self):
        if not self.records:
            return None
        if self.out is None:
            self.open()
        self.out.close()
        done = (self.name, self.records, self.size, self.dict_bytes)
        self.reset()
        return done


def write_archives(pages: DataFrame, folder: str, target: int = 256 << 20, sample: int = 8 << 20, dictionary: int = 64 << 10, level: int = 3) -> DataFrame:
    """Write a record for every row of `pages` (page_id, url, html) and return the manifest.

    target: bytes of records in an archive. sample: bytes of the archive's first records that its
    dictionary is built from. dictionary: the dictionary's size.
    """
    spark = pages.sparkSession
    ship_code(spark)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    winners = written(rows.groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")), "winners")
    # winners of payloads that a share of all pages has are broadcast; their pages meet nothing in the join and are dealt evenly
    hot = hot_keys(winners).select(F.col("sha1").alias("hot"), F.col("winner").alias("known"))
    ids = rows.drop("html").join(F.broadcast(hot), F.col("sha1") == F.col("hot"), "left")
    ids = ids.withColumn("key", F.when(F.col("hot").isNotNull(), F.floor(F.rand(7) * (1 << 40)).cast("string")).otherwise(F.col("sha1")))
    ids = ids.join(winners.select(F.col("sha1").alias("key"), "winner"), "key", "left")
    ids = ids.withColumn("winner", F.when(F.col("hot").isNotNull(), F.col("known")).otherwise(F.col("winner")))
    won = F.col("page_id").eqNullSafe(F.col("winner"))
    revisits = ids.where(~won).select("page_id", "url", "sha1", "payload_bytes", "winner", F.lit(None).cast("string").alias("html"), F.lit("revisit").alias("record_type"))
    first = winners.select(F.col("sha1").alias("won"), "winner")
    # responses carry their payload: joined by id and digest, so that no payload that many pages share is moved in one task
    responses = rows.join(first, F.col("page_id").eqNullSafe(F.col("winner")) & (F.col("sha1") == F.col("won"))).select(
        "page_id", "url", "sha1", "payload_bytes", "winner", "html", F.lit("response").alias("record_type")
    )
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, target, sample, dictionary, level)
        done = []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                done += filter(None, (writer.add(record_bytes(row)) for row in batch.slice(k, 256).to_pylist()))
        done += filter(None, [writer.close()])
        if done:
            names, kinds = ["archive", "n_records", "n_bytes", "dictionary_bytes"], [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names)

    return responses.unionByName(revisits).mapInArrow(write, MANIFEST)


def frames(raw) -> Iterator[bytes]:
    """The decompressed records of an open archive, one at a time."""
    magic, size = struct.unpack("<II", raw.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("not an archive with a leading dictionary")
    decompressor = zstandard.ZstdDecompressor(dict_data=load_dictionary(raw.read(size)))
    left, one = b"", None
    while True:
        chunk = left or raw.read(1 << 20)
        if not chunk:
            if one is not None:
                raise ValueError("the archive ends within a record")
            return
        if one is None:
            one, parts = decompressor.decompressobj(), []
        parts.append(one.decompress(chunk))
        left = b""
        if one.eof:
            left, one = one.unused_data, None
            yield b"".join(parts)


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload length and digest, record_type and refers_to of every archived record.

    A response's length and digest are computed from the payload that was read; a revisit's are
    those its headers give.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                found = []
                with opened(path) as raw:
                    for record in frames(raw):
                        h, body = parse_record(record)
                        page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        kind, url = h["WARC-Type"], h.get("WARC-Target-URI")
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(h["X-Payload-Length"])
                        if kind == "response":
                            got = base64.b32encode(hashlib.sha1(body).digest()).decode()
                            if (got, len(body)) != (digest, size):
                                raise ValueError(f"record of page {page} in {path} is damaged")
                        found.append((page and int(page), url, size, digest, kind, refers and int(refers)))
                        if len(found) == 4096:
                            yield as_records(found)
                            found = []
                if found:
                    yield as_records(found)

    return manifest.select("archive").repartition(partitions(manifest.sparkSession), "archive").mapInArrow(read, RECORDS)


def opened(path: str):
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_stream(inner)


def as_records(found: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = shared_dir(spark, "warc")
    manifest = shared_dir(spark, "warc-manifest")
    write_archives(pages, folder).write.parquet(manifest)
    records = read_archives(spark.read.schema(MANIFEST).parquet(manifest))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: base32 is spelled out: digit i takes the 5 bits from bit 5i of the digest.
OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), w AS (SELECT hex, max(page_id) AS winner FROM p GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + (5 * i) // 4 AS INT), 2) AS INT) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = winner OR winner IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner OR winner IS NULL THEN NULL ELSE winner END AS refers_to
FROM p JOIN w USING (hex)
"""
