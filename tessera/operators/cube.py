"""Filtered search over a hierarchy of grids."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.vectors import l2sq, sound
from ..plans.grid import Grid, adaptive_layers, global_box
from ..plans.shared import written
from .filters import And, Everything, Filter, InBall, InBox, InPolygon
from .graph import GraphIndex
from .knn import FEW_QUERIES, answer, exact_knn, nearest_pairs, valid

#: Stored cubes that a search names to the reader at most, and cubes listed to find them.
MOST_CUBES = 4096
MOST_LISTED = 1 << 20


def _ball_of(keep: Filter):
    """The ball of a filter that is one, or a conjunction with one: a tighter bound than its box."""
    if isinstance(keep, InBall):
        return keep.ball
    if isinstance(keep, And):
        return _ball_of(keep.a) or _ball_of(keep.b)
    return None


@dataclass
class Watch:
    """What a search has done, over its queries. Readable after the search has run; seconds are the caller's."""

    queries: int
    rows: int
    seen: list[tuple[Observation, Observation]]

    def averages(self) -> dict[str, float]:
        """Cubes visited and distances computed a query, and the share of all rows that these are."""
        visited = sum(cubes.get["visited"] for cubes, _ in self.seen)
        distances = sum(pairs.get["distances"] for _, pairs in self.seen)
        n = max(1, self.queries)
        return {"visited": visited / n, "distances": distances / n, "selectivity": distances / n / max(1, self.rows)}

    def per_second(self, seconds: float) -> float:
        """Queries a second of wall time."""
        return self.queries / seconds if seconds > 0 else float("inf")


class CubeIndex:
    """A table of vectors with the cube of every layer beside them.

    Search modes: `exact` scans all rows that pass; `cubes` first turns the filter into a list of cubes
    and joins on them, with the same result; `fly` searches only the cubes that can be reached from the
    filter's center over faces, through cubes that hold a row that passes. (What the last one reaches
    is this library's definition.) The layer is the caller's, or follows from each query's filter: the
    coarsest whose cubes are small against it.

    A saved index is partitioned by the cubes of one layer. A search names to the reader those that its
    filters can touch, if they are MOST_CUBES at most, so that no other file is opened.
    """

    def __init__(self, table: DataFrame, axes: list[str], grid: Grid, dim: int | None = None, stored_layer: int | None = None):
        self.table, self.axes, self.grid, self.dim, self.stored_layer = table, axes, grid, dim, stored_layer

    @classmethod
    def build(cls, table: DataFrame, axes: list[str], layers: int = 3, least_points: int = 50, dim: int | None = None) -> CubeIndex:
        rows = valid(table, axes, dim)
        lo, hi = global_box(rows, axes)
        grid = Grid(tuple(lo), tuple(hi), adaptive_layers(rows.count(), len(axes), layers, least_points))
        return cls(grid.assign(rows, axes), axes, grid, dim)

    @property
    def point(self):
        return [F.col(a) for a in self.axes]

    def save(self, path: str, layer: int | None = None) -> None:
        """The table, partitioned by one layer's cubes, and the grid."""
        layer = self.grid.layers - 1 if layer is None else layer
        keyed = self.table.drop("stored_cube").withColumn("cube_id", F.col(f"cube_{layer}"))
        keyed.repartition("cube_id").write.mode("overwrite").partitionBy("cube_id").parquet(f"{path}/rows")
        about = {"lo": self.grid.lo, "hi": self.grid.hi, "layers": self.grid.layers, "axes": self.axes, "dim": self.dim, "stored_layer": layer}
        spark = self.table.sparkSession
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str, dims: int | None = None) -> CubeIndex:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        if dims is not None and dims != len(about["axes"]):
            raise ValueError(f"the index has {len(about['axes'])} attributes, not {dims}")
        table = spark.read.parquet(f"{path}/rows").withColumnRenamed("cube_id", "stored_cube")
        return cls(table, about["axes"], Grid(tuple(about["lo"]), tuple(about["hi"]), about["layers"]), about["dim"], about["stored_layer"])

    @classmethod
    def load_or_build(cls, spark: SparkSession, path: str, table: DataFrame, axes: list[str], **options) -> CubeIndex:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            cls.build(table, axes, **options).save(path)
        return cls.load(spark, path, len(axes))

    def beside(self, layer: int) -> DataFrame:
        """grp, other: the occupied cubes of a layer that share a face."""
        held = self.table.select(F.col(f"cube_{layer}").alias("grp")).distinct()
        near = self.grid.adjacency(held, "grp", layer).select("grp", F.col("neighbor_id").alias("other"))
        return near.join(held.withColumnRenamed("grp", "other"), "other").select("grp", "other")

    def graph(self, layer: int, m: int = 16, cross: int = 2, **options) -> GraphIndex:
        """A neighbour graph within the cubes of a layer, with edges between cubes that share a face."""
        return GraphIndex.build(self.table, f"cube_{layer}", self.axes, m, beside=self.beside(layer), cross=cross, dim=self.dim, **options)

    def starts(self, queries: DataFrame, keep: Filter, layer: int, mode: str = "cubes") -> DataFrame:
        """qid, grp: where a graph search begins. cubes: in every cube that the filter can touch; fly: in the
        cube of the filter's center, or, if that is empty, as before."""
        listed = self.cube_list(queries, keep, layer).select("qid", F.col("cube_id").alias("grp"))
        if mode == "cubes":
            return listed
        held = self.table.select(F.col(f"cube_{layer}").alias("grp")).distinct()
        center = queries.select("qid", self.grid.cube_of(self.center(keep), layer).alias("grp")).join(held, "grp", "left_semi")
        return center.select("qid", "grp").unionByName(listed.join(center.select("qid"), "qid", "left_anti"))

    def center(self, keep: Filter) -> list:
        box = keep.bounds() or Box(list(self.grid.lo), list(self.grid.hi))
        return box.center() + [(F.lit(a) + F.lit(b)) / 2 for a, b in zip(self.grid.lo[len(box.lo) :], self.grid.hi[len(box.lo) :])]

    def points_per_cube(self, layer: int) -> DataFrame:
        return self.table.groupBy(F.col(f"cube_{layer}").alias("cube_id")).agg(F.count("*").alias("n"))

    def cube_list(self, queries: DataFrame, keep: Filter, layer: int) -> DataFrame:
        """The queries, once for every cube that may hold rows that pass."""
        box, ball = keep.bounds(), _ball_of(keep)
        if ball is not None:
            return self.grid.cubes_of_ball(queries, ball, layer)
        if box is None:
            n = self.grid.cubes(layer) ** self.grid.dims
            return queries.withColumn("cube_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        return self.grid.cubes_of_box(queries, box, layer)

    def layer_for(self, keep: Filter):
        """The layer that suits a filter, as a Column over the queries."""
        if isinstance(keep, InBall):
            return self.grid.layer_for_ball(keep.ball)
        if isinstance(keep, InPolygon):
            return self.grid.layer_for_polygon(keep.polygon)
        box = keep.box if isinstance(keep, InBox) else keep.bounds()
        return F.lit(0) if box is None else self.grid.layer_for_box(box)

    def by_layer(self, queries: DataFrame, keep: Filter, layer: int | None) -> list[tuple[int, DataFrame]]:
        """The queries of each layer that is asked for: no more parts than layers."""
        if layer is not None:
            return [(layer, queries)]
        chosen = queries.withColumn("layer_", self.layer_for(keep).cast("int"))
        found = sorted(r[0] for r in chosen.select("layer_").distinct().collect())
        return [(k, chosen.where(F.col("layer_") == k).drop("layer_")) for k in found]

    def rows_for(self, queries: DataFrame, keep: Filter) -> DataFrame:
        """The table, without the stored cubes that the queries' filters cannot touch."""
        box = keep.bounds()
        if self.stored_layer is None or box is None:
            return self.table
        listed = queries.agg(F.sum(self.grid.cubes_in_box(box, self.stored_layer))).first()[0]
        if listed is None or listed > MOST_LISTED:
            return self.table
        cubes = [r[0] for r in self.cube_list(queries, keep, self.stored_layer).select("cube_id").distinct().limit(MOST_CUBES + 1).collect()]
        return self.table if len(cubes) > MOST_CUBES else self.table.where(F.col("stored_cube").isin(cubes) if cubes else F.lit(False))

    def pairs(self, queries: DataFrame, keep: Filter, mode: str, layer: int) -> DataFrame:
        """The rows that pass beside each query, of the cubes that the mode visits."""
        listed = self.cube_list(queries, keep, layer) if mode == "cubes" else self.reachable(queries, keep, layer)
        rows = self.rows_for(queries, keep).withColumn("cube_id", F.col(f"cube_{layer}"))
        return rows.join(listed, "cube_id").where(keep.column(self.point))

    def search(self, queries: DataFrame, k: int, keep: Filter | None = None, mode: str = "cubes", layer: int | None = None) -> DataFrame:
        """qid, rank, vec_id, dist for queries (qid, qv and the columns that the filter names)."""
        keep, queries = keep or Everything(), queries.where(sound(F.col("qv"), self.dim))
        if mode == "exact" or mode == "cubes" and keep.bounds() is None:
            return exact_knn(self.rows_for(queries, keep), queries, k, self.point, keep, self.dim)
        out = None
        for at, some in self.by_layer(queries, keep, layer):
            listed = self.cube_list(some, keep, at) if mode == "cubes" else self.reachable(some, keep, at)
            # listed once, read by the sample and the search
            listed = written(listed, "listed") if some.count() > FEW_QUERIES else listed
            rows = self.rows_for(some, keep).withColumn("cube_id", F.col(f"cube_{at}"))
            pairs = nearest_pairs(rows.select("vec_id", "embedding", "cube_id", *self.axes), listed, k, keep.column(self.point), self.dim, "cube_id")
            found = answer(pairs.select("qid", "vec_id", "dist"), k)
            out = found if out is None else out.unionByName(found)
        return out if out is not None else exact_knn(self.table, queries, k, self.point, keep, self.dim)

    def watched(self, queries: DataFrame, k: int, keep: Filter, mode: str = "cubes", layer: int | None = None) -> tuple[DataFrame, Watch]:
        """A search, and what it did once it has run: counted by the plan itself, in the same pass."""
        out, seen = None, []
        for at, some in self.by_layer(queries.where(sound(F.col("qv"), self.dim)), keep, layer):
            cubes, pairs = Observation(), Observation()
            listed = (self.cube_list(some, keep, at) if mode == "cubes" else self.reachable(some, keep, at)).observe(cubes, F.count("*").alias("visited"))
            rows = self.rows_for(some, keep).withColumn("cube_id", F.col(f"cube_{at}"))
            passed = rows.join(listed, "cube_id").where(keep.column(self.point)).observe(pairs, F.count("*").alias("distances"))
            found = answer(passed.select("qid", "vec_id", l2sq(F.col("embedding"), F.col("qv"), self.dim).alias("dist")), k)
            out = found if out is None else out.unionByName(found)
            seen.append((cubes, pairs))
        out = out if out is not None else exact_knn(self.table.limit(0), queries, k, self.point, keep, self.dim)
        return out, Watch(queries.count(), self.table.count(), seen)

    def metrics(self, queries: DataFrame, keep: Filter, mode: str = "cubes", layer: int | None = None) -> DataFrame:
        """What a search does for each query: its layer, the cubes visited and in all, the rows in the
        visited cubes, the distances computed, and the share of all rows that they are."""
        total = self.table.agg(F.count("*").alias("rows_"))
        out = None
        for at, some in self.by_layer(queries, keep, layer):
            listed = (self.cube_list(some, keep, at) if mode == "cubes" else self.reachable(some, keep, at)).select("qid", "cube_id")
            held = self.points_per_cube(at)
            visited = listed.join(held, "cube_id", "left").groupBy("qid").agg(F.count("*").alias("visited"), F.sum(F.coalesce("n", F.lit(0))).alias("scanned"))
            passed = self.pairs(some, keep, mode, at).groupBy("qid").agg(F.count("*").alias("distances"))
            zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
            found = some.select("qid").join(visited, "qid", "left").join(passed, "qid", "left").crossJoin(F.broadcast(total))
            found = found.select(
                "qid", F.lit(at).alias("layer"), zero("visited"), F.lit(self.grid.cubes(at) ** self.grid.dims).cast("long").alias("cubes"),
                zero("scanned"), zero("distances"), F.round(F.coalesce("distances", F.lit(0)) / F.col("rows_"), 6).alias("selectivity"),
            )
            out = found if out is None else out.unionByName(found)
        return out

    def reachable(self, queries: DataFrame, keep: Filter, layer: int) -> DataFrame:
        """The queries, once for every cube reached from the filter's center.

        A query's cubes with rows that pass meet in one row: a grid has a bounded number of them."""
        start = queries.select("qid", self.grid.cube_of(self.center(keep), layer).alias("start"))
        rows = self.rows_for(queries, keep).withColumn("cube_id", F.col(f"cube_{layer}")).select("cube_id", *self.axes)
        # a cube is settled by the first of its rows that passes
        cubes, point = self.cube_list(queries.drop("qv"), keep, layer), [F.col(f"r.{a}") for a in self.axes]
        found = cubes.alias("q").join(rows.alias("r"), (F.col("q.cube_id") == F.col("r.cube_id")) & keep.column(point), "left_semi")
        holds = found.groupBy("qid").agg(F.collect_set("cube_id").alias("holds"))
        c, dims = self.grid.cubes(layer), self.grid.dims

        def walk(batches):
            for batch in batches:
                out = []
                for qid, first, held in zip(*(batch.column(x).to_pylist() for x in ("qid", "start", "holds"))):
                    left, seen, front = set(held or ()) - {first}, [first], [first]
                    while front:
                        near = {x + s * c**d for x in front for d in range(dims) for s in (-1, 1) if 0 <= x // c**d % c + s < c}
                        front = list(near & left)
                        left -= near
                        seen += front
                    out += [(qid, x) for x in seen]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], batch.schema.field("qid").type), pa.array([x for _, x in out], pa.int64())], ["qid", "cube_id"])

        kind = queries.schema["qid"].dataType.simpleString()
        reached = start.join(holds, "qid", "left").mapInArrow(walk, f"qid {kind}, cube_id long")
        return queries.join(reached, "qid")
