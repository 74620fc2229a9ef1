"""Source divergence audit: how far the sources of a language differ in their use of words.

Plain relational: the matches of a pattern are exploded and counted by group, groups are crossed with their
language's vocabulary so that absent terms count as zeros, and meet in a self-join on language and term;
sums give the distance of each pair of sources, window ranks the terms that set a source apart.

Defined results: a null text, language or source counts as ''; every (lang, source) that occurs is a group,
also without terms; a language whose vocabulary is empty has distance 0 between its sources; a language with
one source has no pairs; rows that repeat count as often as they stand there; an empty table gives an empty
one; other columns are not looked at, whatever their names. A text's terms are an array in its task's memory,
some 40 bytes a term: a text of 20 MB takes about 300 MB.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, shared_dir, scratch, written

#: Terms are the runs of letters and of all that is not ASCII: the matches of [^\x00-\x40\x5B-\x60\x7B-\x7F]+.
#: A text is cut where they are not, which gives the same matches at a sixth of the time of regexp_extract_all.
BETWEEN = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LEAST_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Groups beyond this number are joined with the vocabulary by a salted key instead of by broadcast.
MOST_BROADCAST = 100_000
SALTS = 64


def terms(text: Column) -> Column:
    """All terms of the text, A-Z lower-cased; empty strings may stand at both ends."""
    return F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN)


def share(count: Column, total: Column, words: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * words)), exact for any counts below 10**19."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, (total + words * SMOOTHING).cast("decimal(20,0)")).cast("long")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, occurrences, documents; a row with an empty term for each group.

    A document's terms leave it an occurrence each, then once each for the document, so that both counts are
    sums that Spark makes in part before it shuffles: no group meets in one task before that.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), F.concat(F.array(F.lit("")), terms(empty("text"))).alias("terms"))
    rows = rows.select("lang", "source", F.size("terms").alias("size"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("place", "term"))
    whole = (F.col("place") >= F.col("size")).cast("int")
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - whole).alias("occurrences"), F.sum(whole).alias("documents"))


def dense(groups: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every group beside every kept term of its language."""
    n = groups.count()
    if n <= MOST_BROADCAST:
        return vocabulary.join(F.broadcast(groups), "lang")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return vocabulary.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the parts `pair` and `term`.

    pair: every other source of the language, by the sum over kept terms of the difference of shares.
    term: the terms that occur in the source with a share above the language's, the first `top` of them.
    A term is kept for a language if it stands in `least_documents` of its documents.
    """
    counts = written(term_counts(docs), "term-counts")
    groups = written(counts.select("lang", "source").distinct(), "groups")
    by_lang = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("occurrences").alias("all"), F.sum("documents").alias("documents"))
    vocabulary = written(by_lang.where(F.col("documents") >= least_documents).select("lang", "term", "all"), "vocabulary")
    kept = counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "occurrences", "all")
    totals = kept.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"))
    words = vocabulary.groupBy("lang").agg(F.count("*").alias("words"), F.sum("all").alias("lang_total"))
    about = groups.join(words, "lang").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    shares = dense(about, vocabulary).join(kept.select("lang", "source", "term", "occurrences"), ["lang", "source", "term"], "left")
    n = F.coalesce("occurrences", F.lit(0))
    shares = shares.select(
        "lang", "source", "term", n.alias("n"), share(n, F.col("total"), F.col("words")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("words")).alias("q")
    )
    shares = written(shares.repartition(partitions(docs.sparkSession), "lang", "term"), "shares")

    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"))
    apart = shares.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("r"))).alias("value"))
    # groups are far fewer than terms; both directions of a pair have one value
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    ordered = pairs.select("lang", "source", "item", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"))
    apart = apart.select("lang", F.col("source").alias("a"), F.col("item").alias("b"), "value")
    pairs = ordered.join(apart, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    above = shares.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(above).where(F.col("rank") <= top))


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """`audit`, written to the shared folder; the tables on the way to it are deleted."""
    spark = docs.sparkSession
    path = shared_dir(spark, "divergence")
    with scratch(spark, "divergence"):
        out = audit(docs, least_documents, top)
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SHARE = "1 + CAST({scale}::HUGEINT * ({n} + {plus}) // ({total} + {plus} * words) AS BIGINT)"
_P = _SHARE.format(scale=SCALE, plus=SMOOTHING, n="coalesce(c.n, 0)", total="coalesce(total, 0)")
_Q = _SHARE.format(scale=SCALE, plus=SMOOTHING, n="v.n", total="lang_total")
OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
t AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row_id) >= {LEAST_DOCUMENTS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT lang, count(*) AS words, sum(n) AS lang_total FROM v GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, {_P} AS p, {_Q} AS q
  FROM g JOIN v USING (lang) JOIN w USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, (SELECT 0) + coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= {TOP}"""
