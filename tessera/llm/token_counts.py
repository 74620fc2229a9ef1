"""Token counts through a digest cache.

Every text is reduced to the SHA-256 digest of its normalised content. Digests are joined to a
table of counts stored under the tokenizer's version digest; only distinct digests that it lacks
are encoded, and their counts are appended to the table.

Defined results: a null text counts as the empty text (0 tokens, 0 bytes); a null id is kept and
counted like any other; rows that repeat (by id, text or both) each give a row; an empty table
gives an empty result; columns other than the id and the text are ignored, whatever their names.
Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, hot_keys, shared_dir, ship_code, text_or_empty, written
from .tokenizer_files import file_digest, load_ranks, load_tokenizer, tokenizer_path

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"

#: Characters whose class (letter, number, space, other) every Unicode version and both libraries'
#: regular expressions give alike. Texts made of them may take the faster library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u017f\u2010-\u2027\u20ac]*")


def count_batches(batches: Iterator[pa.RecordBatch], path: str, ranks_path: str | None) -> Iterator[pa.RecordBatch]:
    tokenizer = load_tokenizer(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    ranks = load_ranks(ranks_path, ()) if ranks_path else None
    for part in by_bytes(batches, "text", 1 << 20):
        texts = part.column("text").to_pylist()
        counts = [0] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if ranks is not None and PLAIN.fullmatch(text) and not any(s in text for s in specials):
                counts[i] = len(ranks.encode_ordinary(text))
            else:
                rest.append(i)
        for k in range(0, len(rest), 16):
            some = rest[k : k + 16]
            for i, e in zip(some, tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)):
                counts[i] = len(e)
        yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts stored for one tokenizer version, one row a digest; a missing table is an empty one."""
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        empty = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return empty.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    cache: str | None = None,
    ranks: str | None = None,
    normalise: Column | None = None,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of `docs`.

    tokenizer: a tokenizers file. ranks: the same vocabulary as tiktoken ranks, if there is one;
    plain texts are then encoded by that library, all others by the first. cache: folder of the
    stored counts, which grows by the misses of this call (a fresh folder if None). normalise: what
    to encode instead of the text itself; it may change counts.
    """
    spark = docs.sparkSession
    ship_code(spark)
    version = file_digest(tokenizer)
    cache = cache or shared_dir(spark, "token-counts")
    text = normalise if normalise is not None else text_or_empty(text_col)
    content = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    content = content.withColumn("digest", F.unhex(F.sha2("text", 256)))
    digests = written(content.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    distinct = written(digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct-digests")
    misses = distinct.select("digest", "first_id").join(read_cache(spark, cache, version), "digest", "left_anti").withColumnRenamed("digest", "missing")
    to_encode = content.join(
        misses.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("missing")), "left_semi"
    ).select("digest", "text")
    counts = to_encode.mapInArrow(lambda batches: count_batches(batches, tokenizer, ranks), "digest binary, n_tokens long")
    counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # counts of texts in a share of all rows are broadcast; their rows meet nothing in the join and are dealt evenly
    stored = read_cache(spark, cache, version)
    hot = stored.join(F.broadcast(hot_keys(distinct).select("digest")), "digest", "left_semi").select(F.col("digest").alias("hot"), F.col("n_tokens").alias("known"))
    rows = digests.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    anywhere = F.unhex(F.hex(F.floor(F.rand(7) * (1 << 40))))
    rows = rows.withColumn("digest", F.when(F.col("hot").isNotNull(), anywhere).otherwise(F.col("digest")))
    counted = rows.join(stored, "digest", "left").withColumn("n_tokens", F.coalesce("known", "n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, tokenizer_path("byte_bpe_50k.json"), ranks=tokenizer_path("byte_bpe_50k.tiktoken"))
