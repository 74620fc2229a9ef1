"""BPE encoding and decoding through a table of distinct words.

Words are the maximal runs without ASCII white space. That split is safe for tokenizers whose
normaliser and pre-tokenizer never look over white space and drop it (`word_bpe_49k.json`): a text's
ids are then its words' ids in order, whichever word they stand in.

1. Documents are read in blocks of bounded size. Each block sends its distinct words, told apart by
   their bytes and dealt into buckets by hash, as one compressed row a bucket.
2. Each bucket meets in one task, which encodes every distinct word of the corpus once and answers
   each block with the ids of its words, in the order in which the block sent them: ids are joined
   back by position, so words need not travel twice, and no word is hot, however common it is.
3. Blocks and answers are shuffled together; each text becomes the concatenation of its words' ids.
4. Decoding joins ids to a table of pieces by id: the table is the vocabulary, bounded, and in order of
   ids, so the join is Arrow's take.

A block is numbered by the split it was read from (not by its task: where answers and texts meet in a union, tasks
are counted over both). Should a split be read differently the second
time, the answer's checksum fails and the block encodes its words itself, with the same result.

Defined results: null and empty texts have no ids; null ids of documents are kept; repeated rows
each give a row; an empty table gives an empty result; other columns are ignored. Texts are taken
whole; one text has to fit into a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, byte_buffers, distinct_segments, partitions, segment_hashes, ship_code, text_or_empty, words_of
from .tokenizer_files import load_tokenizer, tokenizer_path

Batches = Iterator[pa.RecordBatch]
BLOCK_BYTES = 12 << 20
ENCODED = "doc_id long, ids array<int>"
_WORDS = "bucket int, block long, check binary, payload binary"
_ROWS = "block long, kind int, bucket int, check binary, payload binary"


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def blocks(batches: Batches, block_bytes: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(number, slices) of consecutive rows, of about block_bytes of text or one long text."""
    part, seq, held, size = 0, 0, [], 0
    for piece in by_bytes(batches, "text", 1 << 20):
        part = piece.column("split")[0].as_py()
        piece = piece.select(["doc_id", "text"])
        held.append(piece)
        size += piece.nbytes
        if size >= block_bytes:
            yield (part << 24) + seq, held
            seq, held, size = seq + 1, [], 0
    if held:
        yield (part << 24) + seq, held


class BlockWords:
    """The distinct words of a block, told apart by their bytes and dealt into buckets, and where they stand."""

    def __init__(self, pieces: list[pa.RecordBatch], buckets: int):
        raws, begins, stops, self.firsts, self.sizes = [], [], [], [], []
        base = 0
        for piece in pieces:
            raw, offsets = byte_buffers(piece.column("text"))
            starts, ends, first = words_of(raw, offsets)
            begins.append(starts + base)
            stops.append(ends + base)
            self.firsts.append(first)
            self.sizes.append(len(starts))
            raws.append(raw)
            base += len(raw)
        codes, distinct = distinct_segments(np.concatenate(raws), np.concatenate(begins), np.concatenate(stops))
        raw, offsets = byte_buffers(distinct)
        bucket = (segment_hashes(raw, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        data = raw.tobytes()
        self.words = [data[a:b] for a, b in zip(offsets[:-1][order].tolist(), offsets[1:][order].tolist())]
        self.cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.inverse = place[codes]  # each word's number among self.words

    def dealt(self) -> Iterator[tuple[int, list[bytes]]]:
        for b, (x, y) in enumerate(zip(self.cuts, self.cuts[1:])):
            if y > x:
                yield b, self.words[x:y]


def checksum(joined: bytes) -> bytes:
    return hashlib.blake2b(joined, digest_size=12).digest()


def record_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def send_words(batches: Batches, buckets: int, block_bytes: int) -> Batches:
    for block, pieces in blocks(batches, block_bytes):
        rows = []
        for bucket, words in BlockWords(pieces, buckets).dealt():
            joined = b"\n".join(words)
            rows.append((bucket, block, checksum(joined), pack(joined)))
        if rows:
            yield record_batch(rows, ["bucket", "block", "check", "payload"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])


def encode_words(words: list[bytes], path: str) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers."""
    tokenizer = load_tokenizer(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    out = []
    for k in range(0, len(words), 512):
        texts = [w.decode() for w in words[k : k + 512]]
        out += [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return out


def answer(batches: Batches, path: str) -> Batches:
    """Encode each word once over all blocks; ids go back in the order of the block's words."""
    table: dict[bytes, bytes] = {}
    bucket = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["bucket"] != bucket:
                bucket, table = row["bucket"], {}
            words = unpack(row["payload"]).split(b"\n")
            new = [w for w in words if w not in table]
            table.update(zip(new, encode_words(new, path)))
            ids = [table[w] for w in words]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            payload = pack(lengths.astype("<u4").tobytes() + b"".join(ids))
            yield record_batch(
                [(row["block"], 0, bucket, row["check"], payload)],
                ["block", "kind", "bucket", "check", "payload"],
                [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()],
            )


def send_texts(batches: Batches, block_bytes: int) -> Batches:
    for block, pieces in blocks(batches, block_bytes):
        for seq, piece in enumerate(pieces):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema) as out:
                out.write_batch(piece)
            yield record_batch(
                [(block, 1, seq, None, pack(sink.getvalue().to_pybytes()))],
                ["block", "kind", "bucket", "check", "payload"],
                [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()],
            )


def encode_blocks(batches: Batches, path: str, buckets: int) -> Batches:
    """Rows of a block stand together, answers first."""
    block, replies, texts = None, {}, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["block"] != block:
                yield from encode_block(replies, texts, path, buckets)
                block, replies, texts = row["block"], {}, []
            if row["kind"] == 0:
                replies[row["bucket"]] = (row["check"], row["payload"])
            else:
                texts.append(row["payload"])
    yield from encode_block(replies, texts, path, buckets)


def encode_block(replies: dict, texts: list[bytes], path: str, buckets: int) -> Batches:
    pieces = [pa.ipc.open_stream(unpack(x)).read_next_batch() for x in texts]
    if not pieces:
        return
    block = BlockWords(pieces, buckets)
    lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for bucket, words in block.dealt():
        check, payload = replies.pop(bucket, (None, b""))
        if check == checksum(b"\n".join(words)):
            raw = np.frombuffer(unpack(payload), "<i4")
            lengths.append(raw[: len(words)].astype(np.int64))
            ids.append(raw[len(words) :])
        else:
            own = encode_words(words, path)
            lengths.append(np.fromiter(map(len, own), np.int64, len(own)) // 4)
            ids.append(np.frombuffer(b"".join(own), "<i4"))
    length, table = np.concatenate(lengths), np.concatenate(ids)
    begin = np.cumsum(length) - length
    at = 0
    for piece, first, size in zip(pieces, block.firsts, block.sizes):
        word = block.inverse[at : at + size]
        at += size
        n = length[word]
        total = np.append(0, np.cumsum(n))
        values = table[np.repeat(begin[word] - total[:-1], n) + np.arange(total[-1])]
        offsets = pa.array(total[first].astype(np.int32))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(values))], ["doc_id", "ids"])


def encode(
    docs: DataFrame,
    tokenizer: str,
    then: Callable[[Batches], Batches] | None = None,
    schema: str = ENCODED,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id and ids (array of int) of every row.

    tokenizer: a tokenizers file of the kind named above. then: a function on the encoded Arrow
    batches to apply in the same pass, with the schema it returns.
    """
    spark = docs.sparkSession
    ship_code(spark)
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.spark_partition_id().alias("split"))
    words = rows.mapInArrow(lambda b: send_words(b, n, block_bytes), _WORDS)
    replies = words.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: answer(b, tokenizer), _ROWS)
    texts = rows.mapInArrow(lambda b: send_texts(b, block_bytes), _ROWS)
    together = replies.unionByName(texts).repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")
    after = then or (lambda b: b)
    return together.mapInArrow(lambda b: after(encode_blocks(b, tokenizer, n)), schema)


def piece_table(path: str) -> list[str]:
    """Piece of each id: one entry an id of the vocabulary, which bounds it."""
    vocab = load_tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        pieces[i] = piece
    return pieces


def joined(ids: pa.Array, cuts: np.ndarray, pieces: pa.Array) -> pa.Array:
    """Texts of the pieces of ids[cuts[i]:cuts[i + 1]] with a blank between them. pieces: by id, each with a blank behind."""
    raw, at = byte_buffers(pieces.take(ids))
    stop = at[cuts]
    full = np.diff(cuts) > 0
    last = stop[1:][full] - 1  # the blanks behind the last pieces
    inside = np.ones(len(raw), bool)
    inside[last] = False
    offsets = stop - np.append(0, np.cumsum(full))
    return pa.Array.from_buffers(pa.large_string(), len(full), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])


def decode_batches(batches: Batches, path: str) -> Batches:
    """Adds `decoded`: pieces joined to the ids by id, in order.

    Where the tokenizer has no decoder, its own decoding joins pieces by blanks; with a decoder, that is
    applied to each list of pieces.
    """
    decoder = load_tokenizer(path).decoder
    names = piece_table(path)
    pieces = pa.array([f"{p} " for p in names], pa.large_string())
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            column = part.column("ids")
            ids, cuts = column.flatten(), np.append(0, np.cumsum(np.diff(column.offsets.to_numpy())))
            if decoder is None:
                texts = joined(ids, cuts, pieces).cast(pa.string())
            else:
                found = list(map(names.__getitem__, ids.to_pylist()))
                texts = pa.array([decoder.decode(found[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and decoded for every row of `encoded` (doc_id, ids); null ids decode to ''."""
    ship_code(encoded.sparkSession)
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(lambda b: decode_batches(b, tokenizer), f"{ENCODED}, decoded string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_batches(batches: Batches) -> Batches:
    for batch in batches:
        column = batch.column("ids")
        values = column.flatten().to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
        at = (4 * np.append(0, np.cumsum(np.diff(column.offsets.to_numpy())))).tolist()
        raw, place = byte_buffers(batch.column("decoded"))
        place = place.tolist()
        rows = [
            (doc, (b - a) // 4, hashlib.sha256(values[a:b]).hexdigest(), hashlib.sha256(raw[x:y]).hexdigest())
            for doc, a, b, x, y in zip(batch.column("doc_id").to_pylist(), at, at[1:], place, place[1:])
        ]
        yield record_batch(rows, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()])


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Each document's number of tokens and the digests of its ids and of the text decoded from them."""
    return encode(docs, tokenizer, lambda b: digest_batches(decode_batches(b, tokenizer)), DIGESTS)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
