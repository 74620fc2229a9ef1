"""BPE and token counts against the tokenizers library, text by text."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.bpe import decode, encode, encode_digests
from tessera.llm.token_counts import read_cache, token_counts
from tessera.llm.tokenizer_files import file_digest, tokenizer_path

WORD, BYTE, RANKS = (tokenizer_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)


def want(path, text):
    t = Tokenizer.from_file(path)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_encode_and_decode(odd_documents):
    texts = {(r.doc_id, r.text) for r in odd_documents.collect()}
    encoded = encode(odd_documents, WORD, block_bytes=200)
    got = sorted((str(r.doc_id), r.ids) for r in encoded.collect())
    assert len(got) == 9
    assert {(d, json.dumps(i)) for d, i in got} == {(str(d), json.dumps(want(WORD, x)[0])) for d, x in texts}
    decoded = {(str(r.doc_id), r.decoded) for r in decode(encoded, WORD).collect()}
    assert decoded == {(str(d), want(WORD, x)[1]) for d, x in texts}


def test_words_that_a_polynomial_does_not_tell_apart(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    texts = ["".join("ab"[x ^ y] for x in bits) for y in (0, 1)]
    df = spark.createDataFrame([(0, texts[0]), (1, texts[1]), (2, " ".join(texts))], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode(df, WORD).collect()}
    assert got == {0: want(WORD, texts[0])[0], 1: want(WORD, texts[1])[0], 2: want(WORD, " ".join(texts))[0]}


def test_digests(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in encode_digests(documents, WORD).collect():
        ids, text = want(WORD, texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_blocks_get_their_answers(spark, monkeypatch):
    from tessera.llm import bpe

    real = bpe.encode_blocks

    def strict(batches, path, buckets):
        """Blocks that may not encode words themselves."""
        from tessera.llm import bpe as there

        encode_words, there.encode_words = there.encode_words, None
        try:
            yield from real(batches, path, buckets)
        finally:
            there.encode_words = encode_words

    monkeypatch.setattr(bpe, "encode_blocks", strict)
    texts = [f"word{i % 97} and other{i % 31} things" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode(df, WORD, block_bytes=2000).collect()}
    own = Tokenizer.from_file(WORD)
    assert got == {i: own.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}


def test_answers_that_do_not_fit_are_not_used():
    import pyarrow as pa

    from tessera.llm.bpe import BlockWords, encode_block, pack

    piece = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["some plain words"])], ["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, piece.schema) as out:
        out.write_batch(piece)
    replies = {b: (b"wrong", pack(b"")) for b, _ in BlockWords([piece], 4).dealt()}
    batch = next(encode_block(replies, [pack(sink.getvalue().to_pybytes())], WORD, 4))
    assert batch.column("ids").to_pylist() == [want(WORD, "some plain words")[0]]


def test_counts(odd_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    got = token_counts(odd_documents, BYTE, ranks=RANKS, limit=5).collect()
    assert len(got) == len(rows)
    expected = sorted((str(r.doc_id), len((r.text or "").encode()), len(want(BYTE, r.text)[0])) for r in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)


def test_cache_is_used_and_grows_by_misses(spark, documents, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts(documents.limit(10), BYTE, cache, RANKS).count()
    n = spark.read.parquet(cache).count()
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(7).cast("long")).write.parquet(str(tmp_path / "marked"))
    token_counts(documents, BYTE, cache, RANKS).count()
    distinct = documents.select("text").distinct().count()
    assert n <= 10 and spark.read.parquet(cache).count() == distinct
    marked = token_counts(documents.limit(10), BYTE, str(tmp_path / "marked"), RANKS)
    assert {r.n_tokens for r in marked.collect()} == {7}  # nothing was encoded anew
    assert read_cache(spark, str(tmp_path / "marked"), "another version").count() == 0
    assert len(file_digest(BYTE)) == 64


def test_both_libraries_count_alike(spark, documents):
    a = {tuple(r) for r in token_counts(documents, BYTE).collect()}
    assert a == {tuple(r) for r in token_counts(documents, BYTE, ranks=RANKS).collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_digests(none, WORD).count() == 0
    assert token_counts(none, BYTE, ranks=RANKS).count() == 0
