"""python -m tessera: random filters over files of vectors, searched and compared with the exact answer."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import Ball, Box, Polygon
from .functions.workload import random_balls, random_boxes, random_polygons, random_shells
from .operators.cube import CubeIndex
from .operators.evaluate import distance_ratio, recall, selectivity
from .operators.filters import Filter, InBall, InBox, InPolygon, composite
from .operators.trees import TreeIndex
from .plans.grid import global_box
from .sources.records import attach, log_index_time, read_attributes, register, write_log


def filters(spark: SparkSession, shape: str, lo: list[float], hi: list[float], ratio: float, inner: float, sides: int, n: int) -> tuple[DataFrame, Filter]:
    """qid and the filter's columns for n queries, and the filter over them."""
    d = len(lo)
    low, high, center = ([F.col(f"{c}{i}") for i in range(d)] for c in "abc")
    names = lambda c: [f"{c}{i} double" for i in range(d)]
    if shape == "box":
        rows = [(i, *a, *b) for i, (a, b) in enumerate(random_boxes(lo, hi, ratio, n))]
        return spark.createDataFrame(rows, ", ".join(["qid long", *names("a"), *names("b")])), InBox(Box(low, high))
    if shape == "ball":
        rows = [(i, *c, r) for i, (c, r) in enumerate(random_balls(lo, hi, ratio, n))]
        return spark.createDataFrame(rows, ", ".join(["qid long", *names("c"), "r double"])), InBall(Ball(center, F.col("r")))
    if shape == "shell":
        rows = [(i, *a, *b, *c, r) for i, (a, b, c, r) in enumerate(random_shells(lo, hi, ratio, inner, n))]
        schema = ", ".join(["qid long", *names("a"), *names("b"), *names("c"), "r double"])
        return spark.createDataFrame(rows, schema), composite(Box(low, high), Ball(center, F.col("r")), not_ball=True)
    rows = [(i, *(x for v in p for x in v)) for i, p in enumerate(random_polygons(lo, hi, ratio, sides, n))]
    schema = ", ".join(["qid long", *(f"x{i} double, y{i} double" for i in range(sides))])
    return spark.createDataFrame(rows, schema), InPolygon(Polygon([(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(sides)]))


def main(args: list[str] | None = None) -> list[tuple]:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("-s", "--source", required=True, help="folder of the files")
    p.add_argument("-d", "--dataset", required=True, help="DATASET_base.fvecs, DATASET_query.fvecs")
    p.add_argument("-m", "--meta", default="uniform_2d", help="DATASET_metadata_META.bin")
    p.add_argument("-f", "--ratio", type=float, default=0.1, help="share of the space that a filter accepts")
    p.add_argument("-r", "--inner", type=float, default=0.3, help="share of that which a shell leaves out")
    p.add_argument("-v", "--vertices", type=int, default=4)
    p.add_argument("--shape", choices=("box", "ball", "polygon", "shell"), default="box")
    p.add_argument("--index", choices=("cubes", "fly", "rtree", "kdtree"), default="cubes")
    p.add_argument("-l", "--leaf-capacity", type=int, default=1000)
    p.add_argument("-x", "--leaf-oversample", type=int)
    p.add_argument("-k", type=int, nargs="+", default=[20, 100])
    p.add_argument("--log", help="folder to append result lines to")
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    register(spark)
    read = lambda name: spark.read.format("fvecs").load(f"{o.source}/{o.dataset}_{name}.fvecs")
    table = attach(read("base"), read_attributes(spark, f"{o.source}/{o.dataset}_metadata_{o.meta}.bin"))
    axes = [c for c in table.columns if c.startswith("m")]
    vectors = read("query").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    shapes, keep = filters(spark, o.shape, *global_box(table, axes, 0), o.ratio, o.inner, o.vertices, vectors.count())
    queries = vectors.join(shapes, "qid").cache()
    cube = CubeIndex.build(table, axes, layers=6)
    tree = None
    if o.index in ("rtree", "kdtree"):
        began = time.perf_counter()
        tree = TreeIndex.rtree(table, axes, o.leaf_capacity) if o.index == "rtree" else TreeIndex.kdtree(table, axes, 4)
        if o.log:
            log_index_time(spark, f"{o.log}-build", o.dataset, o.index, 1000 * (time.perf_counter() - began))
    print(f"selectivity {selectivity(table, queries, cube.point, keep).agg(F.avg('selectivity')).first()[0]:.4f}")
    out = []
    for k in o.k:
        truth = cube.search(queries, k, keep, "exact").cache()
        began = time.perf_counter()
        if o.index in ("cubes", "fly"):
            found = cube.search(queries, k, keep, o.index)
        else:
            found = tree.search(queries, k, keep, o.leaf_oversample)
        found = found.cache()
        found.count()
        seconds = time.perf_counter() - began
        out.append((k, recall(found, truth, k).first()["recall"], round(seconds, 3), distance_ratio(found, truth).first()["ratio"]))
        print("k {} recall {} wall seconds {} ratio {}".format(*out[-1]))
    if o.log:
        write_log(spark.createDataFrame(out, "k int, recall double, seconds double, ratio double"), o.log, append=True)
    return out


if __name__ == "__main__":
    main()
