"""A KD-tree down to single vectors: nodes are nested intervals of row positions.

Large nodes are split by exact selection: histograms of all nodes of a level narrow down the middle row, so no
row is shuffled for it; as soon as a node has few rows, one task finishes it. Rows are stored in the order of
their positions; a node that lies inside a box is one range of them, whose rows need no test.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import both, single
from ..functions.vectors import l2sq, sound
from ..plans.boxes import meeting, named_ranges, within
from ..plans.shared import removed, ship_code, written
from .filters import Everything, Filter, InBox
from .knn import MOST_BROADCAST, answer, exact_knn, valid

#: Nodes of this many rows are finished by one task.
TASK_ROWS = 1 << 16
#: Buckets of a node's histogram at most, and of all nodes of a level.
BUCKETS, ALL_BUCKETS = 1024, 1 << 20
#: Positions are joined with ranges by blocks of this many.
POSITIONS = 1 << 12


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def select(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, t, left: for each node the value at place `k` (from 0) of its rows' x in order, and that place
    among the rows equal to it. rows: node, x; wanted: node, k, lo, hi (bounds of x)."""
    nodes = wanted.count()
    buckets = max(16, min(BUCKETS, ALL_BUCKETS // max(1, nodes)))
    while wanted.where("lo < hi").head(1):
        near = rows.join(few(wanted), "node").where("x between lo and hi")
        at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))).otherwise(0)
        held = near.groupBy("node", "k", at.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        held = held.withColumn("upto", F.sum("n").over(W.partitionBy("node").orderBy("bucket")))
        wanted = written(held.where("k < upto and k >= upto - n").select("node", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "lo", "hi"), "select")
    return wanted.select("node", F.col("lo").alias("t"), F.col("k").alias("left"))


def split(rows: DataFrame, about: DataFrame, axes: list[str], key: str) -> DataFrame:
    """The rows of every node dealt to its children: the first n // 2 by (value on the widest axis, key) go left."""
    widest = F.greatest(*(F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in axes)) if len(axes) > 1 else F.col(f"hi_{axes[0]}") - F.col(f"lo_{axes[0]}")
    axis = F.coalesce(*(F.when(F.col(f"hi_{a}") - F.col(f"lo_{a}") == widest, F.lit(i)) for i, a in enumerate(axes)))
    chosen = written(about.withColumn("axis", axis), "axis")
    pick = lambda f: F.coalesce(*(F.when(F.col("axis") == i, f(a)) for i, a in enumerate(axes)))
    wanted = chosen.select("node", F.expr("n div 2").alias("k"), pick(lambda a: F.col(f"lo_{a}")).alias("lo"), pick(lambda a: F.col(f"hi_{a}")).alias("hi"))
    valued = rows.join(few(chosen.select("node", "axis", "n")), "node").withColumn("x", pick(lambda a: F.col(a).cast("double")))
    middle = written(select(valued.select("node", "x"), wanted), "middle")
    ties = valued.join(few(middle), "node").where("x = t").select("node", F.col(key).alias("x"), "left")
    bounds = ties.groupBy("node").agg(F.first("left").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    keys = select(ties.select("node", "x"), written(bounds, "ties")).select("node", F.col("t").alias("key_"))
    cut = written(middle.join(keys, "node").select("node", "t", "key_"), "cut")
    right = (F.col("x") > F.col("t")) | (F.col("x") == F.col("t")) & (F.col(key) >= F.col("key_"))
    dealt = valued.join(few(cut), "node").withColumn("right", right.cast("long"))
    return dealt.select(key, *axes, (F.col("node") * 2 + F.col("right")).alias("node"), (F.col("first") + F.col("right") * F.expr("n div 2")).alias("first"))


def described(rows: DataFrame, axes: list[str]) -> DataFrame:
    bounds = [f(a).cast("double").alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("node").agg(F.first("first").alias("first"), F.count("*").alias("n"), *bounds)


def finish(table: pa.Table, axes: list[str], key: str, nodes: bool) -> pa.Table:
    """The subtree under one node: all its nodes, or each row's position."""
    ids = table.column(key).to_numpy()
    x = np.stack([table.column(a).to_numpy().astype(np.float64) for a in axes], axis=1)
    node, first = table.column("node").to_numpy().copy(), table.column("first").to_numpy().copy()
    out: list[tuple] = []
    open_ = np.arange(len(ids))
    while len(open_):
        open_ = open_[np.argsort(node[open_], kind="stable")]
        heads = np.flatnonzero(np.append(True, node[open_][1:] != node[open_][:-1]))
        n = np.diff(np.append(heads, len(open_)))
        lo, hi = np.minimum.reduceat(x[open_], heads, axis=0), np.maximum.reduceat(x[open_], heads, axis=0)
        out.append((node[open_][heads], first[open_][heads], n, lo, hi))
        axis = (hi - lo).argmax(1)
        size = np.repeat(n, n)
        value = x[open_, np.repeat(axis, n)]
        order = np.lexsort((ids[open_], value, node[open_]))
        open_ = open_[order]
        right = np.arange(len(open_)) - np.repeat(heads, n) >= size // 2
        more = size > 1
        open_, right, size = open_[more], right[more], size[more]
        node[open_] = node[open_] * 2 + right
        first[open_] += np.where(right, size // 2, 0)
    if not nodes:
        return pa.table({key: pa.array(ids, pa.int64()), "pos": pa.array(first, pa.int64())})
    joined = [np.concatenate(c) for c in zip(*out)]
    columns = {"node": joined[0], "first": joined[1], "n": joined[2]}
    for i, a in enumerate(axes):
        columns |= {f"lo_{a}": joined[3][:, i], f"hi_{a}": joined[4][:, i]}
    return pa.table(columns)


def kd_tree(points: DataFrame, axes: list[str], task_rows: int = TASK_ROWS, key: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(key and pos of every row; node, first, n and box of every node, from the root, 1, down to single rows).

    A node splits its rows on the axis that spreads most (of equal ones the first) at place n // 2; its
    children are 2 * node and 2 * node + 1. `key` is a key of the points.
    """
    ship_code(points.sparkSession)
    rows = written(points.select(F.col(key).cast("long"), *axes, F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("first")), "kd")
    above = []
    for _ in range(62):
        about = written(described(rows, axes), "nodes")
        most = about.agg(F.max("n")).first()[0]
        if most is None or most <= task_rows:
            break
        above.append(about)
        before, rows = rows, written(split(rows, about, axes, key), "kd")
        removed(before)
    nodes = "node long, first long, n long, " + ", ".join(f"lo_{a} double, hi_{a} double" for a in axes)
    blocks = rows.groupBy("node")
    placed = written(blocks.applyInArrow(lambda t: finish(t, axes, key, False), f"{key} long, pos long"), "placed")
    every = blocks.applyInArrow(lambda t: finish(t, axes, key, True), nodes)
    for about in above:
        every = every.unionByName(about)
    return placed, written(every.repartitionByRange("first", "n").sortWithinPartitions("n"), "nodes")


class KdTree:
    """Rows in the order of their positions (pos), and the tree's nodes. vec_id is a key of the table."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, axes: list[str], dim: int | None = None):
        self.rows, self.nodes, self.axes, self.dim = rows, nodes, axes, dim

    @classmethod
    def build(cls, table: DataFrame, axes: list[str], dim: int | None = None, task_rows: int = TASK_ROWS) -> KdTree:
        sound_rows = valid(table, axes, dim)
        placed, nodes = kd_tree(sound_rows.select("vec_id", *axes), axes, task_rows)
        return cls(sound_rows.join(placed, "vec_id"), nodes, axes, dim)

    def save(self, path: str, files: int | None = None) -> None:
        """Rows sorted by position, `files` files (else as many as shuffle partitions), and the nodes beside them."""
        n = files or int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows.repartitionByRange(n, "pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(f"{path}/rows")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        about = json.dumps({"axes": self.axes, "dim": self.dim})
        self.rows.sparkSession.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark, path: str) -> KdTree:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/nodes"), about["axes"], about["dim"])

    def leaves(self, capacity: int) -> DataFrame:
        """The largest nodes of `capacity` rows or fewer: each row is in one of them."""
        small = self.nodes.where(F.col("n") <= capacity)
        over = self.nodes.where(F.col("n") > capacity).select(F.col("node").alias("over"))
        top = small.withColumn("over", F.shiftright("node", 1))
        return top.join(over, "over", "left_semi").drop("over").unionByName(small.where("node = 1"))

    def ranges(self, queries: DataFrame, keep: Filter, capacity: int = 1000) -> DataFrame:
        """qid, inside, first, last: the positions that a query's filter may accept; `inside`: it accepts all.

        Leaves side by side are one range: a node that lies inside a box is never more than one.
        """
        box = keep.bounds()
        sides = [(F.col(f"lo_{a}"), F.col(f"hi_{a}"), single(lo), single(hi)) for a, lo, hi in zip(self.axes, box.lo, box.hi)]
        inside = both([(a >= lo) & (b <= hi) for a, b, lo, hi in sides]) if isinstance(keep, InBox) else F.lit(False)
        met = meeting(self.leaves(capacity), self.axes, queries, box).select("qid", inside.alias("inside"), "first", (F.col("first") + F.col("n") - 1).alias("last"))
        order = W.partitionBy("qid", "inside").orderBy("first")
        gap = F.coalesce((F.lag("last").over(order) + 1 < F.col("first")).cast("int"), F.lit(0))
        islands = met.withColumn("gap", gap).withColumn("island", F.sum("gap").over(order))
        return islands.groupBy("qid", "inside", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")

    def read(self, ranges: DataFrame) -> DataFrame:
        """The rows at the ranges' positions, named to the reader as a few ranges that hold them all."""
        return within(self.rows, "pos", named_ranges(ranges, "first", "last"))

    def search(self, queries: DataFrame, k: int, keep: Filter | None = None, capacity: int = 1000) -> DataFrame:
        """qid, rank, vec_id, dist, as by comparing all."""
        keep, queries = keep or Everything(), queries.where(sound(F.col("qv"), self.dim))
        if keep.bounds() is None:
            return exact_knn(self.rows, queries, k, [F.col(a) for a in self.axes], keep, self.dim)
        ranges = written(self.ranges(queries, keep, capacity), "ranges")
        block = lambda x: F.expr(f"{x} div {POSITIONS}")
        listed = ranges.withColumn("block_", F.explode(F.sequence(block("first"), block("last"))))
        pairs = self.read(ranges).withColumn("block_", block("pos")).join(listed, "block_").where("pos between first and last")
        pairs = pairs.join(few(queries), "qid").where(F.col("inside") | keep.column([F.col(a) for a in self.axes]))
        return answer(pairs.select("qid", "vec_id", l2sq(F.col("embedding"), F.col("qv"), self.dim).alias("dist")), k)
