"""Language identification by compression.

Each language has a raw-content Zstandard dictionary made of texts known to be in it. A text is
compressed against every dictionary, in pieces of a few kilobytes so that each part of a long text
counts alike, and takes the language that compresses it best. Where the best and the second differ
by less than `margin` of the size, the text is rejected (`und`).

Dictionaries come from a bounded sample: of every language the `sample_docs` rows whose ids hash
smallest, `sample_chars` characters of each, cut to `dictionary_bytes`. Languages are counted first; only
rows under a hash that follows from the count are ranked. The rows to predict are read whole.

Defined results: null texts and texts without a letter are `und` with score 0; where nothing can be
learned every text is; ties between languages (very short texts) go to the one whose dictionary holds more of the words, then
to the name that sorts first; rows without a
language or a text teach nothing; null ids and repeated rows each give a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, held_out, ship_code

Batches = Iterator[pa.RecordBatch]
SAMPLE_DOCS = 256
SAMPLE_CHARS = 4096
DICTIONARY_BYTES = 112 << 10
PIECE = 4096
MARGIN = 0.01
LEVEL = 9
#: Bytes of difference that divide the odds of two languages by e.
TEMPERATURE = 8.0
#: Every text is compressed once a language, so their number is bounded.
MOST_LANGUAGES = 256

LETTER = re.compile(r"[^\W\d_]")
NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return f" {NO_LETTERS.sub(' ', text.lower()).strip()} ".encode()


def learn(
    labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, sample_chars: int = SAMPLE_CHARS, most_languages: int = MOST_LANGUAGES
) -> dict[str, bytes]:
    """Dictionary of each language of `labelled` (doc_id, lang, text)."""
    rows = labelled.where("lang is not null and text is not null").withColumn("h", F.xxhash64("doc_id", "lang"))
    # a language's share of the hashes that its rows have: about twice the sample, without a text moved
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages cannot be told apart")
    if not counts:
        return {}
    cuts = {r["lang"]: min(1.0, (2 * sample_docs + 64) / r["n"]) for r in counts}
    share = F.element_at(F.create_map(*(F.lit(x) for kv in cuts.items() for x in kv)), F.col("lang"))
    few = rows.where((share >= 1.0) | (F.col("h").cast("double") < (share * 2 - 1) * float(1 << 63)))
    order = W.partitionBy("lang").orderBy("h", "doc_id")
    few = few.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample_docs).select("lang", "rn", F.substring("text", 1, sample_chars).alias("text"))
    found: dict[str, list[bytes]] = {}
    for r in few.orderBy("lang", "rn").collect():
        found.setdefault(r["lang"], []).append(letters(r["text"]))
    return {lang: b" ".join(texts)[:dictionary_bytes].ljust(8) for lang, texts in sorted(found.items())}


def sizes(text: bytes, coders: list[zstandard.ZstdCompressor]) -> list[int]:
    pieces = [text[k : k + PIECE] for k in range(0, len(text), PIECE)]
    return [sum(len(c.compress(p)) for p in pieces) for c in coders]


def classify(batches: Batches, dictionaries: dict[str, bytes], margin: float) -> Batches:
    names = list(dictionaries)
    coders = []
    for raw in dictionaries.values():
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(raw), source_size=PIECE, min_match=3, write_content_size=False)
        data.precompute_compress(compression_params=options)
        coders.append(zstandard.ZstdCompressor(dict_data=data, compression_params=options))
    known = [set(raw.split()) for raw in dictionaries.values()]
    for part in by_bytes(batches, "text", 1 << 20):
        best, score, accepted = [], [], []
        for text in part.column("text").to_pylist():
            if not names or text is None or not LETTER.search(text):
                best.append("und"), score.append(0.0), accepted.append(False)
                continue
            plain = letters(text)
            took = sizes(plain, coders)
            least = min(took)
            first = took.index(least)
            if took.count(least) > 1:  # too short to tell by size: by the words that the dictionaries hold
                words = plain.split()
                first = max((i for i, s in enumerate(took) if s == least), key=lambda i: (sum(w in known[i] for w in words), -i))
            second = min((s for i, s in enumerate(took) if i != first), default=math.inf)
            best.append(names[first])
            score.append(1 / sum(math.exp(min(0.0, (least - s) / TEMPERATURE)) for s in took))
            accepted.append(second - least >= margin * least)
        rest = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in rest), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
            [*rest, "best", "score", "accepted"],
        )


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred (`und` where rejected), score, best (the nearest language even so), accepted."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lambda b: classify(b, dictionaries, margin), "doc_id long, best string, score double, accepted boolean")
    return out.select("doc_id", F.when(F.col("accepted"), F.col("best")).otherwise("und").alias("lang_pred"), "score", "best", "accepted")


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = learn(docs.where(~held_out()).select("doc_id", "lang", "text"))
    found = identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out().alias("held_out"), F.col("best").alias("lang_pred"), "score", "accepted")
