"""A corpus pipeline of the training-data operators: toxic documents go, of near duplicates one stays,
repeated passages are taken out, documents with benchmark items go, and what is left is tokenised.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of their input, whatever their names; the last returns a row of ids for each document.

Defined results: null and empty texts pass every stage (they score what the classifier's bias gives, are
nobody's copy, hold nothing) and have no ids of tokens; rows without an id stay where only an id could
tell which of them goes; rows that repeat are treated alike; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_digests
from tessera.llm.common import shared_dir
from tessera.llm.decontam import decontaminate
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.near_dups import near_duplicates
from tessera.llm.tokenizer_files import tokenizer_path
from tessera.llm.toxicity import THRESHOLD, judge, sample, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold."""
    model = train(sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judge(docs, model, keep_under=THRESHOLD)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id. Rows of a repeated id all stay or
    go together, rows without an id stay."""
    gone = near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id").distinct().hint("shuffle_hash")
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document holds; n_chars follows the text."""
    # all other columns travel in one, so that none is taken for the operator's own
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = dedup_lines(docs.select("doc_id", "text", F.struct(F.lit(0).alias("x"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own))).alias("rest")))
    columns = {c: F.col(f"rest.c{i}") for i, c in enumerate(own)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in own:
        columns["n_chars"] = F.when(F.size("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    return encode_digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dups", near_dups), ("line_dedup", line_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: No SQL: toxicity is a trained classifier, and decontamination searches a latent space.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_dir(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
