from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.queries import ORACLES, QUERIES


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, sf).cache()
        assert kept.count() <= before.count(), name
        if name != "bpe":
            assert kept.columns == docs.columns
    assert kept.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0.5 * docs.count() < kept.count()
    again = corpus_pipeline.run(spark, sf)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in kept.collect()}


def test_odd_rows(spark, sf, odd_documents):
    docs = odd_documents.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.col("n_tokens").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        assert stage(spark, docs, sf).count() > 0


def test_clashing_columns_and_long_texts_come_through(spark, sf, odd_documents):
    names = ["gone", "toxicity", "removed", "kept", "d", "g", "rest", "none", "toxic", "h", "text_", "rest_", "none_", "repeats_", "word", "z"]
    docs = odd_documents.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(f"own {n}").alias(n) for n in names))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names), name
    by_id = {r.doc_id: r for r in rows}
    # 6 is a copy of 1; null and empty texts, and the one of 30,000 words but for its repeats, stay
    assert {1, 2, 3, 4, 5, 7} <= set(by_id) and 6 not in by_id and by_id[2].text is None and by_id[3].text == ""
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert corpus_pipeline.bpe(spark, kept, sf).count() == len(rows)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
