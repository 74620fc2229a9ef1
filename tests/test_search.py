"""Edge cases of filters, grids, trees, sources and workloads."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.geometry import Ball, Box, Polygon
from tessera.functions.workload import DISTRIBUTIONS, attribute_points, random_balls, random_boxes, random_polygons, random_shells
from tessera.operators.cube import CubeIndex
from tessera.operators.evaluate import recall
from tessera.operators.filters import Everything, InBall, InBox, InPolygon, Not, Predicate, composite
from tessera.operators.flat import FlatIndex
from tessera.operators.trees import TreeIndex
from tessera.plans.grid import Grid, adaptive_layers
from tessera.sources.records import attach, log_index_time, query_vectors, read_attributes, register, write_log, write_records


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(5)) for _ in range(4)], rng.random(), rng.random()) for i in range(300)]
    rows.append((300, rows[0][1], 0.5, 0.5))
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, m0 float, m1 float").cache()


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(2)
    rows = [(q, [float(rng.randrange(5)) for _ in range(4)], rng.random(), rng.random()) for q in range(6)]
    return spark.createDataFrame(rows, "qid long, qv array<float>, c0 float, c1 float").cache()


def brute(table, queries, k, test):
    out = set()
    base = table.collect()
    for q in queries.collect():
        some = [(sum((a - b) ** 2 for a, b in zip(r.embedding, q.qv)), r.vec_id) for r in base if test(r, q)]
        out |= {(q.qid, i + 1, v, d) for i, (d, v) in enumerate(sorted(some)[:k])}
    return out


def got(df):
    return {tuple(r) for r in df.select("qid", "rank", "vec_id", "dist").collect()}


def f32(x):
    return float(np.float32(x))


def ball_test(r, q):
    return (r.m0 - q.c0) ** 2 + (r.m1 - q.c1) ** 2 <= f32(0.3) ** 2


SHAPES = {
    "box": (lambda: InBox(Box([0.25, 0.25], [0.75, 0.5])), lambda r, q: 0.25 <= r.m0 <= 0.75 and 0.25 <= r.m1 <= 0.5),
    "ball": (lambda: InBall(Ball([F.col("c0"), F.col("c1")], 0.3)), ball_test),
    "all": (lambda: Everything(), lambda r, q: True),
    "none": (lambda: InBox(Box([2.0, 2.0], [3.0, 3.0])), lambda r, q: False),
    "not ball": (lambda: Not(InBall(Ball([F.col("c0"), F.col("c1")], 0.3))), lambda r, q: not ball_test(r, q)),
    "box or ball": (lambda: InBox(Box([0.0, 0.0], [0.25, 0.25])) | InBall(Ball([F.col("c0"), F.col("c1")], 0.3)), lambda r, q: r.m0 <= 0.25 and r.m1 <= 0.25 or ball_test(r, q)),
    "own": (lambda: Predicate(F.col("vec_id") % 3 == 0), lambda r, q: r.vec_id % 3 == 0),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_every_search_gives_the_brute_force_answer(table, queries, shape):
    keep, test = SHAPES[shape]
    want = brute(table, queries, 5, test)
    index = CubeIndex.build(table, ["m0", "m1"], layers=3, least_points=1, dim=4)
    assert got(index.search(queries, 5, keep(), "cubes", 1)) == want
    assert got(FlatIndex(["m0", "m1"]).build(table).search(queries, 5, keep())) == want


def test_trees_give_the_brute_force_answer(table, queries):
    keep, test = SHAPES["box"]
    want = brute(table, queries, 5, test)
    assert got(TreeIndex.rtree(table, ["m0", "m1"], 40).search(queries, 5, keep())) == want
    assert got(TreeIndex.kdtree(table, ["m0", "m1"], 3).search(queries, 5, keep())) == want


def test_save_and_load(spark, table, queries, tmp_path):
    path = str(tmp_path / "index")
    index = CubeIndex.load_or_build(spark, path, table, ["m0", "m1"], layers=2, least_points=1, dim=4)
    assert got(index.search(queries, 3, InBox(Box([0.0, 0.0], [1.0, 1.0])))) == brute(table, queries, 3, lambda r, q: True)
    with pytest.raises(ValueError):
        CubeIndex.load(spark, path, 3)
    loaded = CubeIndex.load(spark, path)
    for keep, test in (
        (InBox(Box([0.1, 0.1], [0.2, 0.15])), lambda r, q: f32(0.1) <= r.m0 <= f32(0.2) and f32(0.1) <= r.m1 <= f32(0.15)),
        (InBall(Ball([F.col("c0"), F.col("c1")], 0.05)), lambda r, q: (r.m0 - q.c0) ** 2 + (r.m1 - q.c1) ** 2 <= f32(0.05) ** 2),
    ):
        for mode in ("cubes", "exact"):
            found = loaded.search(queries, 3, keep, mode)
            plan = found._jdf.queryExecution().toString()
            assert "PartitionFilters: [cube_id" in plan or "PartitionFilters: [isnotnull(cube_id" in plan
            assert got(found) == brute(table, queries, 3, test)
    nowhere = loaded.search(queries, 3, InBox(Box([5.0, 5.0], [6.0, 6.0])))
    assert nowhere.count() == 0


def test_layers_follow_from_the_filters(table, queries):
    index = CubeIndex.build(table, ["m0", "m1"], layers=4, least_points=1, dim=4)
    for keep, test in ((InBall(Ball([F.col("c0"), F.col("c1")], 0.3)), ball_test), (SHAPES["box"][0](), SHAPES["box"][1])):
        assert got(index.search(queries, 5, keep)) == brute(table, queries, 5, test)
    wide, narrow = (index.metrics(queries, InBall(Ball([F.col("c0"), F.col("c1")], r))).collect() for r in (0.9, 0.01))
    assert {r.layer for r in wide} == {0} and {r.layer for r in narrow} == {3}
    assert all(r.visited <= r.cubes and r.distances <= r.scanned for r in wide + narrow)


def test_trees_never_pair_all_with_all(spark, table, queries, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for index in (TreeIndex.rtree(table, ["m0", "m1"], 40), TreeIndex.kdtree(table, ["m0", "m1"], 3)):
            path = str(tmp_path / index.kind)
            index.save(path)
            again = TreeIndex.load(spark, path)
            assert (again.axes, again.kind) == (["m0", "m1"], index.kind)
            keep, test = SHAPES["box"]
            for scan in (False, True):
                found = again.search(queries, 5, keep(), force_scan=scan)
                assert "CartesianProduct" not in found._jdf.queryExecution().toString()
                assert got(found) == brute(table, queries, 5, test)
            assert got(again.search(queries, 5)) == brute(table, queries, 5, lambda r, q: True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_build_times_and_queries_from_numpy(spark, tmp_path):
    log_index_time(spark, str(tmp_path / "log"), "toy", "cubes", 1500.0)
    log_index_time(spark, str(tmp_path / "log"), "toy", "rtree", 250.0)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "log")).collect()) == ["toy cubes index_time_sec: 1.5", "toy rtree index_time_sec: 0.25"]
    assert query_vectors(spark, [np.zeros(3), [1, 2, 3]]).count() == 2
    for wrong in ([np.zeros((1, 3))], [np.zeros(2), np.zeros(3)]):
        with pytest.raises(ValueError):
            query_vectors(spark, wrong)


def test_polygon_boundary_is_half_open(spark):
    square = Polygon([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
    points = [(0.0, 0.5, True), (0.5, 0.0, True), (0.0, 0.0, True), (1.0, 0.5, False), (0.5, 1.0, False), (1.0, 1.0, False), (0.5, 0.5, True), (2.0, 0.5, False)]
    df = spark.createDataFrame(points, "x double, y double, inside boolean")
    assert df.where(square.contains([F.col("x"), F.col("y")]) != F.col("inside")).count() == 0
    one = spark.range(1).select(square.area(), Polygon([(0.0, 0.0), (1.0, 1.0)]).area()).first()
    assert tuple(one) == (1.0, 0.0)


def test_closed_edges_and_zero_radius(spark):
    df = spark.createDataFrame([(0.25,), (0.75,), (0.5,)], "m0 float")
    assert df.where(Box([0.25], [0.75]).contains([F.col("m0")])).count() == 3
    assert df.where(Ball([0.5], 0.0).contains([F.col("m0")])).count() == 1
    with pytest.raises(ValueError):
        Box([0.0], [1.0, 2.0])


def test_composite_truth_table(spark):
    df = spark.createDataFrame([(x / 10, y / 10) for x in range(11) for y in range(11)], "m0 float, m1 float")
    box, ball = Box([0.2, 0.2], [0.8, 0.8]), Ball([0.5, 0.5], 0.2)
    p = [F.col("m0"), F.col("m1")]
    count = lambda f: df.where(f.column(p)).count()
    b, r = count(composite(box)), count(composite(ball=ball))
    assert count(composite()) == 121
    assert count(composite(box, ball, not_ball=True)) == b - r
    assert count(composite(box, ball, any_of=True)) == b
    assert count(composite(box, not_box=True)) == 121 - b


def test_grid_without_extent_and_outside_points(spark):
    grid = Grid((0.0, 5.0), (1.0, 5.0), 2)
    df = spark.createDataFrame([(-3.0, 5.0), (9.0, 5.0), (0.5, 5.0)], "x double, y double")
    assert sorted(r[0] for r in df.select(grid.cube_of([F.col("x"), F.col("y")], 0)).collect()) == [0, 1, 1]
    assert adaptive_layers(500, 2, 6, 50) == 1 and adaptive_layers(2000, 2, 6, 50) == 2 and adaptive_layers(10**6, 4, 6, 50) == 3


def test_cube_lists_hold_every_match(spark):
    grid = Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), 3)
    rng = random.Random(3)
    boxes = random_boxes([0.0] * 3, [1.0] * 3, 0.05, 20, 5)
    q = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(boxes)], "qid long, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    box = Box([F.col(f"a{i}") for i in range(3)], [F.col(f"b{i}") for i in range(3)])
    points = spark.createDataFrame([tuple(rng.random() for _ in range(3)) for _ in range(200)], "x double, y double, z double")
    p = [F.col(c) for c in "xyz"]
    direct = points.join(q, box.contains(p)).count()
    listed = grid.cubes_of_box(q, box, 1)
    assert points.withColumn("cube_id", grid.cube_of(p, 1)).join(listed, "cube_id").where(box.contains(p)).count() == direct > 0


def test_binary_files_round_trip(spark, table, tmp_path):
    register(spark)
    fvecs, attrs = str(tmp_path / "v.fvecs"), str(tmp_path / "m.bin")
    write_records(table, fvecs, "fvecs", "vec_id", "embedding", 4)
    write_records(table, attrs, "attributes", "vec_id", ["m0", "m1"], 2)
    vectors = spark.read.format("fvecs").load(fvecs)
    points = read_attributes(spark, attrs)
    want = {(r.vec_id, tuple(r.embedding), r.m0, r.m1) for r in table.collect()}
    assert {(r.vec_id, tuple(r.embedding), r.m0, r.m1) for r in attach(vectors, points).collect()} == want
    with pytest.raises(ValueError):
        attach(vectors.where("vec_id > 0"), points)
    ids = spark.createDataFrame([(0, [3, 1]), (1, [2, 0])], "qid long, ids array<int>")
    write_records(ids, str(tmp_path / "t.ivecs"), "ivecs", "qid", "ids", 2)
    assert sorted(map(tuple, ((r.qid, tuple(r.ids)) for r in spark.read.format("ivecs").load(str(tmp_path / "t.ivecs")).collect()))) == [(0, (3, 1)), (1, (2, 0))]
    write_log(ids.select("qid"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2


def test_workloads(spark):
    for kind in DISTRIBUTIONS:
        s = attribute_points(spark, kind, 400, 2).agg(F.min("m0"), F.max("m0"), F.avg("m0"), F.count("*")).first()
        assert 0 <= s[0] <= s[1] <= 1 and abs(s[2] - 0.5) < 0.25 and s[3] == 400
    with pytest.raises(ValueError):
        attribute_points(spark, "odd", 1, 1)
    lo, hi = [0.0, 0.0], [1.0, 2.0]
    assert all(l >= a and h <= b for bl, bh in random_boxes(lo, hi, 0.1, 30) for l, h, a, b in zip(bl, bh, lo, hi))
    assert all(r == pytest.approx(2 * math.sqrt(0.1) / 2) for _, r in random_balls(lo, hi, 0.1, 5))
    assert len(random_shells(lo, hi, 0.1, 0.3, 4)) == 4
    assert all(len(p) == 5 and all(0 <= x <= 1 and 0 <= y <= 2 for x, y in p) for p in random_polygons(lo, hi, 0.1, 5, 10))


def test_polygon_cover_holds_all_and_knows_the_inside(spark):
    rng = random.Random(6)
    grid = Grid((0.0, 0.0), (1.0, 1.0), 5)
    points = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(4000)], "vec_id long, m0 float, m1 float")
    for vertices in ([(0.1, 0.1), (0.9, 0.2), (0.5, 0.8)], [(0.2, 0.2), (0.8, 0.2), (0.2, 0.8), (0.8, 0.8)], [(0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.5)]):
        polygon = Polygon(vertices)
        one = spark.range(1).withColumnRenamed("id", "qid")
        cover = {r.cube_id: r.inside for r in grid.cover_of_polygon(one, polygon, 4).collect()}
        assert len(cover) < grid.cubes_of_polygon(one, polygon, 4).count() or len(vertices) == 4
        rows = points.select(grid.cube_of([F.col("m0"), F.col("m1")], 4).alias("cube"), polygon.contains([F.col("m0"), F.col("m1")]).alias("passes")).collect()
        assert any(cover.values())
        for r in rows:
            assert r.passes <= (r.cube in cover) and (not cover.get(r.cube) or r.passes)


def test_polygons_lie_about_the_middle():
    for p in random_polygons([0.0, 0.0], [1.0, 1.0], 1e-6, 3, 200):
        assert all(0.19 < x < 0.81 and 0.19 < y < 0.81 for x, y in p)


def test_flat_index_is_stored(spark, table, queries, tmp_path):
    index = FlatIndex(["m0", "m1"]).build(table)
    index.save(str(tmp_path / "flat"))
    again = FlatIndex(["m0", "m1"]).load(spark, str(tmp_path / "flat"))
    keep = InBox(Box([0.2, 0.2], [0.8, 0.8]))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(again.search(queries, 5, keep)) == rows(index.search(queries, 5, keep)) != []


def test_recall_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], "qid long, rank int, vec_id long, dist double")
    assert recall(empty, empty, 5).first()["recall"] is None


def test_unbuilt_index_is_an_error(queries):
    with pytest.raises(RuntimeError):
        FlatIndex(["m0"]).search(queries, 1)
