"""Exact filtered nearest neighbours of a batch of queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import l2sq, sound
from ..plans.shared import written
from ..plans.tiles import SLACK, within
from .filters import Everything, Filter

#: A side is broadcast only if it has at most this many rows.
MOST_BROADCAST = 4096
#: With more queries than this, one in SAMPLE rows is searched first, to bound the search of all.
FEW_QUERIES = 64
SAMPLE = 64
#: Queries of which so many times k rows pass in the sample (in one of SAMPLE, if that is less) have all rows compared
#: before the filter is tested: an eighth of the rows at most is as near as the bound.
ENOUGH = 8
#: Where more pairs than this would be as near as the bound, the sample grows, to one in STEP rows at most; where the
#: sample itself has more pairs, a sample of it bounds it in turn.
PAIRS, STEP = 1 << 22, 8


def top_k(pairs: DataFrame, k: int, by: str = "dist", tie: str = "vec_id", query: str = "qid") -> DataFrame:
    """The k nearest of each query with their rank; ties go to the smaller id.

    Spark turns the rank limit into a partial one before the shuffle, so that at most k rows of a query
    leave a task.
    """
    order = W.partitionBy(query).orderBy(by, tie)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def answer(pairs: DataFrame, k: int) -> DataFrame:
    return top_k(pairs, k).select("qid", "rank", "vec_id", "dist")


def paired(base: DataFrame, queries: DataFrame, test: Column | None = None, asked: int | None = None) -> DataFrame:
    """Rows beside queries, where `test` holds; the base is read once, however many queries there are.

    Few queries are broadcast. More are copied to as many parts as a shuffle has, into which the rows are
    dealt: each part joins its rows with all queries. asked: the number of queries, if it is known.
    """
    test = F.lit(True) if test is None else test
    if (queries.count() if asked is None else asked) <= MOST_BROADCAST:
        return base.join(F.broadcast(queries), test)
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = base.withColumn("part_", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    # the rows of a part are held, the queries stream by
    return asked.hint("merge").join(rows, "part_").where(test).drop("part_")


def nearest_pairs(base: DataFrame, queries: DataFrame, k: int, test: Column, dim: int | None, key: str | None = None) -> DataFrame:
    """Pairs that pass, with dist, among them the k nearest of each query; all columns but the vectors. key: a column
    in which both have to be equal (queries hold a row for each of its values).

    Where there are many queries, the k-th nearest of a sample of the rows bounds how far the k-th nearest of all
    can be: pairs beyond it are dropped at once instead of being sorted. Large samples are bounded by smaller ones, so
    that all but the smallest are compared like the whole. No row is left out: every bound only drops what is farther.
    """
    dist = l2sq(F.col("embedding"), F.col("qv"), dim)
    n = queries.count()
    if n <= FEW_QUERIES:
        return met(base, queries, test, n, key).withColumn("dist", dist).drop("embedding", "qv")
    rows = base.count()
    shares = sample_shares(rows, n, k)
    some = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(shares[0])) == 0)
    small = rows <= shares[0] * MOST_BROADCAST
    found = met(some, queries, test, n, key, small).withColumn("dist", dist)
    passed = met(some.drop("embedding"), queries.drop("qv"), test, n, key, small).groupBy("qid").agg((F.count("*") * shares[0]).alias("passed_"))
    asked = queries.join(passed, "qid", "left")
    for before, share in zip(shares, [*shares[1:], 1]):
        bounds = top_k(found.select("qid", "vec_id", "dist"), k).where(F.col("rank") == k).select("qid", (F.col("dist") * SLACK).alias("tau_"))
        asked = asked.join(bounds, "qid", "left").withColumn("tau_", F.coalesce("tau_", F.lit(float("inf"))))
        # vectors without an end have no distances to bound by
        many = F.coalesce(F.col("passed_"), F.lit(0)) >= ENOUGH * k * max(before, SAMPLE)
        asked = written(asked.withColumn("many_", many & (F.col("tau_") < float("inf"))), "bounded")
        some = base if share == 1 else base.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0)
        found = bounded_pairs(some, asked.drop("passed_"), n, test, dist, key)
        asked = asked.drop("tau_", "many_")
    return found


def sample_shares(rows: int, asked: int, k: int) -> list[int]:
    """One in how many rows each sample has, the smallest sample first."""
    step = min(SAMPLE, max(STEP, PAIRS // (asked * k)))
    shares = [step]
    while step > 1 and rows * asked > PAIRS * shares[0] and rows > ENOUGH * k * step * shares[0]:
        shares.insert(0, step * shares[0])
    return shares


def met(rows: DataFrame, asks: DataFrame, test: Column, asked: int, key: str | None, small: bool = False) -> DataFrame:
    """Pairs where `test` holds; many queries are dealt out to meet rows that are few enough to be broadcast."""
    if key:
        return rows.join(asks, key).where(test)
    if small and asked > MOST_BROADCAST:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return asks.repartition(parts, "qid").join(F.broadcast(rows), test)
    return paired(rows, asks, test, asked)


def bounded_pairs(base: DataFrame, asked: DataFrame, n: int, test: Column, dist: Column, key: str | None) -> DataFrame:
    """The pairs of nearest_pairs that lie within the queries' tau_. Where many_ is set, distances come first, block by
    block (plans/tiles.py), and the filter is tested on what is near; for the rest the filter comes first."""
    length = lambda v: F.sqrt(F.aggregate(F.col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rest = asked.where("not many_").withColumn("length_q", length("qv"))
    few = rest.count()
    tiled = within(base, asked.where("many_"), key).where(test).drop("many_")
    if not few:
        return tiled
    gap = F.col("length_v") - F.col("length_q")
    # lengths are rounded: a hair more is let through
    close = gap * gap <= F.col("tau_") * (1 + 1e-9) + 1e-9
    pairs = met(base.withColumn("length_v", length("embedding")), rest, test & close, few, key)
    # counting the distances also keeps the filter above their projection, else the join's condition would hold
    # them a second time, in code too long to be compiled
    counted = pairs.withColumn("dist", dist).observe(f"distances-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("distances"))
    counted = counted.where("dist <= tau_").drop("tau_", "many_", "length_q", "length_v", "embedding", "qv")
    return counted if few == n else tiled.unionByName(counted)


def valid(table: DataFrame, axes: list[str], dim: int | None = None) -> DataFrame:
    """The rows that an index holds: with a vector that can be searched and a number on every axis, in single precision."""
    rows = table.where(sound(F.col("embedding"), dim))
    for a in axes:
        rows = rows.where(F.col(a).isNotNull() & ~F.isnan(a))
    return rows.withColumns({a: F.col(a).cast("float") for a in axes})


def exact_knn(base: DataFrame, queries: DataFrame, k: int, point: list[Column], keep: Filter | None = None, dim: int | None = None, extra: list[str] | None = None) -> DataFrame:
    """qid, rank, vec_id, dist: for each query (qid, qv, filter columns) the k nearest rows of `base`
    (vec_id, embedding, attributes) that pass the filter. Rows and queries without a sound vector take no part."""
    test = (keep or Everything()).column(point)
    base, queries = base.where(sound(F.col("embedding"), dim)), queries.where(sound(F.col("qv"), dim))
    return answer(nearest_pairs(base, queries, k, test, dim).select("qid", "vec_id", "dist"), k)


def post_filter(base: DataFrame, queries: DataFrame, k: int, point: list[Column], keep: Filter, oversample: int = 4, dim: int | None = None) -> DataFrame:
    """Filter after the search: of the k * oversample nearest rows those that pass, at most k.

    An approximate mode: it can return fewer than k rows though more would pass.
    """
    base, queries = base.where(sound(F.col("embedding"), dim)), queries.where(sound(F.col("qv"), dim))
    pairs = nearest_pairs(base, queries, k * oversample, F.lit(True), dim)
    return answer(top_k(pairs, k * oversample).drop("rank").where(keep.column(point)), k)
