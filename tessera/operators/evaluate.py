"""Quality of results against the exact answer, and selectivity of filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2sq
from .filters import Filter
from .knn import paired


def stored_truth(lists: DataFrame, queries: DataFrame, base: DataFrame, k: int, dim: int | None = None) -> DataFrame:
    """qid, rank, vec_id, dist of true neighbours stored as lists (qid, ids), as an ivecs file holds them: the
    first k of each list, in its order; their distances are computed anew."""
    found = lists.select("qid", F.posexplode(F.slice("ids", 1, k)).alias("place", "vec_id"))
    pairs = found.select("qid", (F.col("place") + 1).alias("rank"), F.col("vec_id").cast("long").alias("vec_id"))
    pairs = pairs.join(base.select("vec_id", "embedding"), "vec_id").join(queries.select("qid", "qv"), "qid")
    return pairs.select("qid", "rank", "vec_id", l2sq(F.col("embedding"), F.col("qv"), dim).alias("dist"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Common rows over true rows, summed over all queries; null if there is no true row."""
    t = truth.where(F.col("rank") <= k).select("qid", "vec_id")
    f = found.where(F.col("rank") <= k).select("qid", "vec_id").withColumn("hit", F.lit(1))
    both = t.join(f, ["qid", "vec_id"], "left").agg(F.sum("hit").alias("hits"), F.count("*").alias("all"))
    return both.select(F.coalesce("hits", F.lit(0)).alias("hits"), F.col("all").alias("relevant"), F.round(F.try_divide(F.coalesce("hits", F.lit(0)), "all"), 6).alias("recall"))


def distance_ratio(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean over queries of the mean of found over true distance, rank by rank (1 where both are 0)."""
    t = truth.select("qid", "rank", F.sqrt("dist").alias("t"))
    pairs = found.select("qid", "rank", F.sqrt("dist").alias("f")).join(t, ["qid", "rank"])
    ratio = F.when(F.col("t") > 0, F.col("f") / F.when(F.col("t") > 0, F.col("t"))).when(F.col("f") == 0, 1.0)
    return pairs.groupBy("qid").agg(F.avg(ratio).alias("r")).agg(F.round(F.avg("r"), 6).alias("ratio"))


def selectivity(base: DataFrame, queries: DataFrame, point: list[Column], keep: Filter) -> DataFrame:
    """Share of the rows that pass, for each query; queries without any count as 0."""
    n = base.agg(F.count("*").alias("n_"))
    passed = paired(base, queries, keep.column(point)).groupBy("qid").agg(F.count("*").alias("passed"))
    every = queries.select("qid").join(passed, "qid", "left").crossJoin(F.broadcast(n))
    return every.select("qid", F.coalesce("passed", F.lit(0)).alias("passed"), F.round(F.coalesce("passed", F.lit(0)) / F.col("n_"), 6).alias("selectivity"))


def sweep(search, truth: DataFrame, k: int, knobs: list[int], enough: float = 0.995) -> list[tuple[int, float]]:
    """(knob, recall) for growing knobs, until the recall is enough. search: knob -> results."""
    out = []
    for knob in knobs:
        out.append((knob, recall(search(knob), truth, k).first()["recall"]))
        if out[-1][1] is not None and out[-1][1] > enough:
            break
    return out
