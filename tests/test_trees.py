"""Trees with stored nodes: boxes met without comparing all, ranges that the reader cuts, nodes down to single rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.geometry import Ball, Box
from tessera.operators.filters import InBall, InBox, Not
from tessera.operators.kdtree import KdTree, kd_tree
from tessera.operators.knn import exact_knn
from tessera.operators.trees import TreeIndex
from tessera.plans.boxes import meeting, named_ranges, within


def points(spark, n, seed=0, values=None):
    rng = random.Random(seed)
    draw = (lambda: float(rng.choice(values))) if values else rng.random
    return spark.createDataFrame([(i * 3, [rng.random(), rng.random()], draw(), draw()) for i in range(n)], "vec_id long, embedding array<float>, m0 float, m1 float")


def brute_nodes(rows):
    """rows: (id, m0, m1). (node, first, n, box) of every node."""
    out, stack = set(), [(1, 0, rows)]
    while stack:
        node, first, held = stack.pop()
        spans = [(min(r[a] for r in held), max(r[a] for r in held)) for a in (1, 2)]
        out.add((node, first, len(held), *spans[0], *spans[1]))
        if len(held) > 1:
            axis = 1 if spans[0][1] - spans[0][0] >= spans[1][1] - spans[1][0] else 2
            held, half = sorted(held, key=lambda r: (r[axis], r[0])), len(held) // 2
            stack += [(2 * node, first, held[:half]), (2 * node + 1, first + half, held[half:])]
    return out


@pytest.mark.parametrize("values, n", [(None, 300), ([1, 2, 2.5], 201), ([7], 90), (None, 1)])
def test_nodes_down_to_single_rows(spark, values, n):
    table = points(spark, n, n, values)
    placed, nodes = kd_tree(table, ["m0", "m1"], task_rows=40)
    want = brute_nodes([(r.vec_id, r.m0, r.m1) for r in table.collect()])
    got = [(r.node, r.first, r.n, r.lo_m0, r.hi_m0, r.lo_m1, r.hi_m1) for r in nodes.collect()]
    assert len(got) == 2 * n - 1 and set(got) == want
    assert sorted(r.pos for r in placed.collect()) == list(range(n))


def test_no_points(spark):
    placed, nodes = kd_tree(points(spark, 0), ["m0", "m1"])
    assert placed.count() == nodes.count() == 0


@pytest.mark.parametrize("values", [None, [0, 0.25, 0.5, 1]])
def test_meeting_boxes(spark, values):
    rng = random.Random(3)
    draw = (lambda: float(rng.choice(values))) if values else rng.random

    def box():
        (a, b), (c, d) = (sorted((draw(), draw())) for _ in range(2))
        return a, b, c, d

    boxes, asked = [(i, *box()) for i in range(150)], [(i, *box()) for i in range(40)] + [(90, 2.0, 3.0, 2.0, 3.0), (91, -9.0, 9.0, -9.0, 9.0), (92, 0.9, 0.1, 0.0, 1.0)]
    left = spark.createDataFrame(boxes, "leaf_id long, lo_x float, hi_x float, lo_y float, hi_y float")
    right = spark.createDataFrame(asked, "qid long, a double, b double, c double, d double")
    met = meeting(left, ["x", "y"], right, Box([F.col("a"), F.col("c")], [F.col("b"), F.col("d")]))
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and "Cartesian" not in met._jdf.queryExecution().toString()
    got = [(r.qid, r.leaf_id) for r in met.collect()]
    single = {r.leaf_id: r for r in left.collect()}

    rounded = {r.qid: r for r in right.select("qid", *(F.col(c).cast("float").cast("double").alias(c) for c in "abcd")).collect()}
    want = {
        (q, i) for q, r in rounded.items() for i, s in single.items() if r.a <= r.b and r.c <= r.d and s.hi_x >= r.a and s.lo_x <= r.b and s.hi_y >= r.c and s.lo_y <= r.d
    }
    assert len(got) == len(set(got)) and set(got) == want


def test_ranges(spark):
    df = spark.createDataFrame([(0, 3), (4, 5), (1000, 1001), (1000000, 1000000)], "first long, last long")
    ranges = named_ranges(df, "first", "last")
    assert ranges == [(0, 1001), (1000000, 1000000)]
    assert named_ranges(df.limit(0), "first", "last") == []
    assert within(spark.range(10), "id", [(2, 3), (8, 20)]).count() == 4 and within(spark.range(10), "id", []).count() == 0


FILTERS = {
    "box": lambda: InBox(Box([F.col("q0") - 0.05, F.col("q1") - 0.1], [F.col("q0") + 0.05, F.col("q1") + 0.1])),
    "ball": lambda: InBall(Ball([F.col("q0"), F.col("q1")], 0.1)),
    "both": lambda: InBox(Box([0.2], [0.5])) & Not(InBall(Ball([F.col("q0"), F.col("q1")], 0.1))),
    "not": lambda: Not(InBox(Box([0.2, 0.2], [0.9, 0.9]))),
}


def pushed(df) -> str:
    return [line for line in df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PushedFilters" in line][0]


@pytest.mark.parametrize("kind", ["rtree", "kdtree", "nodes"])
def test_stored_trees_read_ranges(spark, tmp_path, kind):
    table = points(spark, 2000, 4)
    axes, path = ["m0", "m1"], str(tmp_path / kind)
    build = {
        "rtree": lambda: TreeIndex.rtree(table, axes, 50, 2),
        "kdtree": lambda: TreeIndex.kdtree(table, axes, 5, 2),
        "nodes": lambda: KdTree.build(table, axes, 2, task_rows=300),
    }[kind]
    build().save(path, files=16)
    index = (KdTree if kind == "nodes" else TreeIndex).load(spark, path)
    asked = table.where("vec_id in (300, 303, 1500)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), F.col("m0").alias("q0"), F.col("m1").alias("q1"))
    rows = lambda df: [tuple(r) for r in df.orderBy("qid", "rank").collect()]
    options = {"capacity": 30} if kind == "nodes" else {}
    for keep in FILTERS.values():
        want = rows(exact_knn(table, asked, 7, [F.col(a) for a in axes], keep(), 2))
        found = index.search(asked, 7, keep(), **options)
        assert rows(found) == want
        assert "NestedLoop" not in found._jdf.queryExecution().toString() or keep().bounds() is None
    one = asked.where("qid = 300")
    if kind == "nodes":
        read = index.read(index.ranges(one, FILTERS["box"](), 30))
        column = "pos"
    else:
        column = "leaf_id"
        read = within(index.leaves, column, named_ranges(index.visited(one, FILTERS["box"]()), column, column))
    assert f"GreaterThanOrEqual({column}," in pushed(read) and f"LessThanOrEqual({column}," in pushed(read)
    files = read.select(F.input_file_name()).distinct().count()
    assert 0 < files < 16
