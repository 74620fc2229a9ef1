"""Partitioning trees: sort-tile-recursive (R-tree) leaves and KD-tree nodes, and searches over them."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import both, single
from ..functions.vectors import l2sq, sound
from ..plans.boxes import meeting, named_ranges, within
from ..plans.shared import ranked, written
from .filters import Everything, Filter, InBox
from .knn import MOST_BROADCAST, answer, exact_knn, valid


def str_leaves(points: DataFrame, axes: list[str], capacity: int = 1000, key: str = "vec_id") -> DataFrame:
    """`points` with slice_id and leaf_id: slices by the first axis, leaves of `capacity` rows by the second."""
    n = points.count()
    slices = max(1, math.ceil(math.sqrt(math.ceil(n / capacity))))
    rows = ranked(points, F.col(axes[0]), F.col(key)).withColumn("slice_id", F.floor((F.col("rn") - 1) / (slices * capacity)).cast("long"))
    if len(axes) == 1:
        return rows.withColumn("leaf_id", F.floor((F.col("rn") - 1) / capacity).cast("long")).drop("rn")
    # a slice holds about sqrt(n * capacity) rows: one task can rank it
    within = W.partitionBy("slice_id").orderBy(axes[1], key)
    leaf = F.col("slice_id") * slices + F.floor((F.row_number().over(within) - 1) / capacity)
    return rows.withColumn("leaf_id", leaf.cast("long")).drop("rn")


def kd_leaves(points: DataFrame, axes: list[str], depth: int, key: str = "vec_id") -> DataFrame:
    """`points` with leaf_id after `depth` splits at the middle row of the axis that spreads most.

    Every level sorts the whole table once by (node, value, key), so no node is one task's work; of
    equal spreads the first axis is taken. A node's children are 2 * node and 2 * node + 1.
    """
    rows = points.withColumn("node", F.lit(0).cast("long"))
    for _ in range(depth):
        spans = [(F.max(a).cast("double") - F.min(a).cast("double")).alias(f"s{i}_") for i, a in enumerate(axes)]
        nodes = rows.groupBy("node").agg(F.count("*").alias("n_"), *spans)
        widest = F.greatest(*(F.col(f"s{i}_") for i in range(len(axes)))) if len(axes) > 1 else F.col("s0_")
        value = F.coalesce(*(F.when(F.col(f"s{i}_") == widest, F.col(a).cast("double")) for i, a in enumerate(axes)))
        split = rows.join(nodes, "node").withColumn("value_", value)
        split = ranked(split, F.col("node"), F.col("value_"), F.col(key))
        split = written(split, "kd")
        first = split.groupBy("node").agg(F.min("rn").alias("first_"))
        place = F.col("rn") - F.col("first_")
        rows = split.join(first, "node").withColumn("node", F.col("node") * 2 + F.when(place >= F.floor(F.col("n_") / 2), 1).otherwise(0))
        rows = rows.select(*points.columns, "node")
    return rows.withColumnRenamed("node", "leaf_id")


def leaf_boxes(leaves: DataFrame, axes: list[str]) -> DataFrame:
    """Each leaf's rows and bounding box."""
    bounds = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    return leaves.groupBy("leaf_id").agg(F.count("*").alias("n"), *bounds)


class TreeIndex:
    """Leaves of either tree with their boxes; a search visits the leaves whose boxes meet the filter's.

    kind: "rtree" or "kdtree". vec_id is a key of the table: the trees are built of it and the axes alone.
    A saved tree's rows stand in the order of their leaves, its boxes beside them: a search names to the reader
    the ranges of leaves that it visits, which the files' statistics cut.
    """

    def __init__(self, leaves: DataFrame, axes: list[str], dim: int | None = None, kind: str = "rtree", boxes: DataFrame | None = None, stored: bool = False):
        self.leaves, self.axes, self.dim, self.kind = leaves, axes, dim, kind
        self.boxes = boxes if boxes is not None else leaf_boxes(leaves, axes)
        self.stored = stored

    @classmethod
    def _of(cls, table: DataFrame, leaves: DataFrame, axes: list[str], dim: int | None, kind: str) -> TreeIndex:
        leaves = written(leaves.select("vec_id", *axes, "leaf_id"), "leaves")
        return cls(table.join(leaves.select("vec_id", "leaf_id"), "vec_id"), axes, dim, kind, written(leaf_boxes(leaves, axes), "boxes"))

    @classmethod
    def rtree(cls, table: DataFrame, axes: list[str], capacity: int = 1000, dim: int | None = None) -> TreeIndex:
        table = valid(table, axes, dim)
        return cls._of(table, str_leaves(table.select("vec_id", *axes), axes, capacity), axes, dim, "rtree")

    @classmethod
    def kdtree(cls, table: DataFrame, axes: list[str], depth: int, dim: int | None = None) -> TreeIndex:
        table = valid(table, axes, dim)
        return cls._of(table, kd_leaves(table.select("vec_id", *axes), axes, depth), axes, dim, "kdtree")

    def save(self, path: str, files: int | None = None) -> None:
        """Rows in the order of their leaves, in `files` files (else as many as shuffle partitions)."""
        n = files or int(self.leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.leaves.repartitionByRange(n, "leaf_id").sortWithinPartitions("leaf_id").write.mode("overwrite").parquet(f"{path}/rows")
        self.boxes.write.mode("overwrite").parquet(f"{path}/boxes")
        about = json.dumps({"axes": self.axes, "dim": self.dim, "kind": self.kind})
        self.leaves.sparkSession.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark, path: str) -> TreeIndex:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(spark.read.parquet(f"{path}/rows"), about["axes"], about["dim"], about["kind"], spark.read.parquet(f"{path}/boxes"), True)

    def counters(self, scan_threshold: int = 100) -> DataFrame:
        """Leaves, and how many of them are small enough to scan: a KD node under the threshold, an R-tree leaf up to it."""
        small = F.col("n") < scan_threshold if self.kind == "kdtree" else F.col("n") <= scan_threshold
        return self.boxes.agg(F.count("*").alias("leaves"), F.count_if(small).alias("scan_leaves"))

    def visited(self, queries: DataFrame, keep: Filter) -> DataFrame:
        """The queries, once for every leaf whose box meets the filter's bounds; `inside_` where the filter is
        a box that holds the leaf whole. A filter without bounds visits every leaf, query by query."""
        box, boxes = keep.bounds(), self.boxes.drop("n")
        if box is None:
            every = boxes.crossJoin(F.broadcast(queries) if queries.count() <= MOST_BROADCAST else queries)
            return every.select(*queries.columns, "leaf_id", F.lit(isinstance(keep, Everything)).alias("inside_"))
        inside = F.lit(False)
        if isinstance(keep, InBox):
            sides = zip(self.axes, box.lo, box.hi)
            inside = both([(F.col(f"lo_{a}").cast("double") >= single(lo)) & (F.col(f"hi_{a}").cast("double") <= single(hi)) for a, lo, hi in sides])
        return meeting(boxes, self.axes, queries, box).select(*queries.columns, "leaf_id", inside.alias("inside_"))

    def search(self, queries: DataFrame, k: int, keep: Filter | None = None, leaf_oversample: int | None = None, force_scan: bool = False) -> DataFrame:
        """qid, rank, vec_id, dist. Rows of leaves that lie inside a box need no test (force_scan: tested
        all the same). leaf_oversample: take that many times k nearest of each leaf before the filter
        (approximate) instead of filtering first."""
        keep, queries = keep or Everything(), queries.where(sound(F.col("qv"), self.dim))
        test = keep.column([F.col(a) for a in self.axes])
        if not force_scan:
            test = F.col("inside_") | test
        if keep.bounds() is None and not leaf_oversample:
            return exact_knn(self.leaves, queries, k, [F.col(a) for a in self.axes], keep, self.dim)
        visits, rows = self.visited(queries, keep).select("qid", "leaf_id", "inside_"), self.leaves
        if self.stored:
            visits = written(visits, "visits")
            rows = within(rows, "leaf_id", named_ranges(visits, "leaf_id", "leaf_id"))
        asked = F.broadcast(queries) if queries.count() <= MOST_BROADCAST else queries
        pairs = rows.join(visits, "leaf_id").join(asked, "qid")
        dist = l2sq(F.col("embedding"), F.col("qv"), self.dim).alias("dist")
        if leaf_oversample:
            near = W.partitionBy("qid", "leaf_id").orderBy("dist", "vec_id")
            pairs = pairs.withColumn("dist", dist).withColumn("r_", F.row_number().over(near)).where(F.col("r_") <= max(k, k * leaf_oversample))
            return answer(pairs.where(test).select("qid", "vec_id", "dist"), k)
        return answer(pairs.where(test).select("qid", "vec_id", dist), k)
