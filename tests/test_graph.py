"""Neighbour graphs, edges between groups and best-first search against comparing all."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.geometry import Ball, Box
from tessera.operators import graph as module
from tessera.operators.cube import CubeIndex
from tessera.operators.evaluate import recall, sweep
from tessera.operators.filters import InBall, InBox, Predicate
from tessera.operators.flat import FlatIndex
from tessera.operators.graph import GraphIndex, counts, nearest_across, neighbour_graph, results
from tessera.operators.knn import exact_knn
from tessera.operators.trees import TreeIndex

DIM = 16


def clustered(n, seed=0, groups=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, DIM))
    x = (centers[rng.integers(0, 20, n)] + 0.5 * rng.normal(size=(n, DIM))).astype(np.float32)
    p = rng.random((n, 2)).astype(np.float32)
    return pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "a0": p[:, 0], "a1": p[:, 1], "grp": np.arange(n) % groups})


def frame(spark, df):
    rows = [(int(i), e.tolist(), float(a), float(b), int(g)) for i, e, a, b, g in df.itertuples(index=False)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, a0 float, a1 float, grp long")


def true_edges(df, beside, k):
    x, out = np.stack(df.embedding.to_numpy()).astype(float), set()
    for u in range(len(df)):
        near = [v for v in range(len(df)) if v != u and (df.grp[u], df.grp[v]) in beside]
        out |= {(u, v) for _, v in sorted((((x[u] - x[v]) ** 2).sum(), v) for v in near)[:k]}
    return out


def test_edges_across_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 16)
    df = clustered(150, 1, 4)
    df["embedding"] = [np.round(x) for x in df.embedding]  # ties
    beside = {(0, 1), (1, 0), (2, 3), (2, 1), (2, 2)}
    got = nearest_across(frame(spark, df), spark.createDataFrame(sorted(beside), "grp long, other long"), 3)
    rows = [(r.u, r.v) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == true_edges(df, beside, 3)


def test_small_groups_are_linked_whole(spark):
    df = clustered(60, 2, 12).iloc[:-4]
    got = {(r.u, r.v) for r in neighbour_graph(frame(spark, df), 8).collect()}
    assert got == {(u, v) for u in df.vec_id for v in df.vec_id if u != v and u % 12 == v % 12}
    assert neighbour_graph(frame(spark, df.iloc[:1]), 8).count() == 0


@pytest.fixture(scope="module")
def one_group(spark):
    df = clustered(3000, 3)
    return df, GraphIndex.build(frame(spark, df).repartition(4), "grp", ["a0", "a1"], m=12, dim=DIM)


def test_descent_finds_the_nearest(spark, one_group):
    df, index = one_group
    near = {(r.u, r.v) for r in index.edges.where("kind = 0").select("u", "v").collect()}
    x = np.stack(df.embedding.to_numpy()).astype(float)
    d = (x * x).sum(1)[:, None] - 2 * x @ x.T + (x * x).sum(1)
    np.fill_diagonal(d, np.inf)
    true = {(u, v) for u, row in enumerate(np.argsort(d, axis=1)[:, :12].tolist()) for v in row}
    assert len(true & near) >= 0.95 * len(true)
    out = index.edges.groupBy("u").count().agg(F.max("count")).first()[0]
    assert out <= 12 + 24 + 2  # own, back and random edges


def test_search_measures_a_part_and_finds_what_passes(spark, one_group):
    df, index = one_group
    asked = frame(spark, df[df.vec_id % 50 == 0]).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), "a0", "a1")
    asked = asked.withColumnsRenamed({"a0": "q0", "a1": "q1"})
    starts = asked.select("qid", F.lit(0).alias("grp"))
    for keep in (None, InBox(Box([0.1, 0.2], [0.8, 0.9])), InBall(Ball([F.col("q0"), F.col("q1")], 0.4))):
        truth = exact_knn(index.nodes, asked, 10, [F.col("a0"), F.col("a1")], keep, DIM).cache()
        seen = index.seen(asked, starts, keep, 48, width=32)
        assert recall(results(seen, 10), truth, 10).first()["recall"] >= 0.9
        cost = counts(seen).agg(F.avg("distances").alias("d"), F.avg("hops").alias("h"), F.count("*").alias("n")).first()
        assert cost["n"] == 60 and 32 <= cost["h"] <= cost["d"] < 0.6 * len(df)
    found = sweep(lambda ef: index.search(asked, starts, 10, keep, ef, width=40), truth, 10, [10, 40], 2.0)
    assert found[0][1] <= found[1][1]


def test_cubes_fly_and_stored(spark, tmp_path):
    df = clustered(600, 5)
    index = CubeIndex.build(frame(spark, df), ["a0", "a1"], layers=2, least_points=1, dim=DIM)
    index.graph(0, m=10).save(str(tmp_path / "g"))
    graph = GraphIndex.load(spark, str(tmp_path / "g"), ["a0", "a1"], DIM)
    asked = frame(spark, df[df.vec_id % 50 == 0]).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    keep = InBox(Box([0.3, 0.3], [0.9, 0.7]))
    truth = exact_knn(index.table, asked, 5, index.point, keep, DIM)
    for mode in ("cubes", "fly"):
        found = graph.search(asked, index.starts(asked, keep, 0, mode), 5, keep, 40, across=mode == "fly", width=40)
        assert recall(found, truth, 5).first()["recall"] >= 0.9
    apart = {(r.u, r.v) for r in graph.edges.where("kind = 2").collect()}
    cubes = dict(index.table.select("vec_id", "cube_0").collect())
    assert apart and all(bin(cubes[u] ^ cubes[v]).count("1") == 1 for u, v in apart)
    # a filter whose center lies in an empty cube begins wherever it reaches
    nowhere = index.starts(asked, InBox(Box([5.0, 5.0], [6.0, 6.0])), 0, "fly")
    assert nowhere.select("qid").distinct().count() in (0, asked.count())


def walk_of(edges, entries, x, q, passes, ef, width):
    """Best-first search of one query, node after node."""
    known = {v: False for v in entries}
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
    dist = lambda v: (((x[v] - q) ** 2).sum(), v)
    while True:
        go, passed = [], 0
        for v in sorted(known, key=dist):
            if not known[v] and passed < ef and len(go) < width:
                go.append(v)
            passed += passes[v]
        if not go:
            return known
        for v in go:
            known[v] = True
        for v in set().union(*(near.get(v, ()) for v in go)):
            known.setdefault(v, False)


def test_search_is_best_first_in_files(spark, tmp_path):
    """What a search meets and expands, over groups and without cross edges, with a filter by name; several parts."""
    df = clustered(400, 8, 3)
    rows = frame(spark, df)
    beside = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "grp long, other long")
    index = GraphIndex.build(rows, "grp", ["a0", "a1"], m=6, beside=beside, entries=3, dim=DIM)
    x, passes = np.stack(df.embedding.to_numpy()).astype(float), (df.a0 > 0.4).to_numpy()
    edges = index.edges.collect()
    asked = rows.where("vec_id % 80 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    # a query without a vector, and one without starts
    asked = asked.unionByName(spark.createDataFrame([(1, None), (2, [0.0] * DIM)], "qid long, qv array<float>"))
    starts = asked.where("qid <> 2").select("qid", F.lit(1).cast("long").alias("grp"))
    entries = [r.vec_id for r in index.entries.where("grp = 1").collect()]
    for across in (False, True):
        got = {}
        for r in index.seen(asked, starts, Predicate(F.col("a0") > 0.4), 5, across, 4).collect():
            got.setdefault(r.qid, {})[r.node] = r.expanded
            assert r.passes == passes[r.node] and abs(r.dist - ((x[r.node] - x[r.qid]) ** 2).sum()) < 1e-9
        some = [(r.u, r.v) for r in edges if across or r.kind < 2]
        assert got == {q: walk_of(some, entries, x, x[q], passes, 5, 4) for q in range(0, 400, 80)}
        found = index.search(asked, starts, 3, Predicate(F.col("a0") > 0.4), 5, across, 4)
        true = [(q, v) for q, met in got.items() for v in sorted((v for v in met if passes[v]), key=lambda v: ((x[v] - x[q]) ** 2).sum())[:3]]
        assert sorted((r.qid, r.vec_id) for r in found.collect()) == sorted(true)


def test_groups_are_linked_whole_up_to_a_bound(spark):
    """Smaller groups get the true edges, larger ones those of the descent."""
    rng = np.random.default_rng(4)
    df = clustered(900, 4)
    df["embedding"], df["grp"] = list(rng.normal(size=(900, DIM)).astype(np.float32)), (np.arange(900) >= 300).astype(int)
    true = {g: {(u, v) for u, v in true_edges(df, {(g, g)}, 12)} for g in (0, 1)}
    for whole, exact in ((module.WHOLE, {0, 1}), (300, {0}), (0, set())):
        near = {(r.u, r.v) for r in module.linked(frame(spark, df), 12, 12, DIM, whole).collect()}
        for g in (0, 1):
            own = {(u, v) for u, v in near if df.grp[u] == g}
            if g in exact:
                assert own == true[g]
            else:
                assert len(own & true[g]) >= 0.8 * len(true[g]), len(own & true[g]) / len(true[g])


@pytest.mark.parametrize("n, k, far", [(1, 3, 0.0), (700, 1, 0.0), (5000, 4, 0.0), (5000, 20, 1000.0), (3000, 3, 1e20)])
def test_few_nearest_holds_the_nearest(n, k, far):
    rng = np.random.default_rng(n + k)
    a, b = rng.normal(size=(150, DIM)) + far, np.round(rng.normal(size=(n, DIM)), 1) + far
    i, j = module.few_nearest(a, b, k)
    d = ((a[:, None] - b) ** 2).sum(2)
    pairs = set(zip(i.tolist(), j.tolist()))
    last = np.sort(d, axis=1)[:, min(k, n) - 1]
    assert all((u, v) in pairs for u, v in zip(*np.nonzero(d <= last[:, None])))
    assert far or len(i) <= 150 * (2 * k + 20)


ODD = [
    (0, [0.0, 0.0], 0.1, 0.5),
    (1, [1.0, 0.0], 0.3, 0.5),
    (2, [2.0, 0.0], 0.9, 0.1),
    (100, [0.0, 0.0], None, 0.5),
    (101, None, 0.2, 0.5),
    (102, [0.0, 0.0], 0.2, None),
    (103, [0.0, 0.0], math.nan, 0.5),
    (104, [math.nan, 0.0], 0.2, 0.5),
    (105, [None, 0.0], 0.2, 0.5),
    (106, [0.0], 0.2, 0.5),
    (107, [], 0.2, 0.5),
    (3, [3.0, 0.0], 0.2, 0.5),
    (4, [0.5, 0.0], 0.5, 1.0),
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows_in_every_index(spark, kind):
    """Null, NaN and short values are in no index; bounds hold in single precision whatever the axes' type."""
    table = spark.createDataFrame(ODD, f"vec_id long, embedding array<float>, m0 {kind}, m1 {kind}")
    asked = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, [math.nan, 0.0])], "qid long, qv array<float>")
    axes, box = ["m0", "m1"], InBox(Box([0.1, 0.0], [0.3, 1.0]))
    indexes = {
        "flat": FlatIndex(axes, 2).build(table).search,
        "cube": CubeIndex.build(table, axes, layers=2, least_points=1, dim=2).search,
        "rtree": TreeIndex.rtree(table, axes, capacity=2, dim=2).search,
        "kdtree": TreeIndex.kdtree(table, axes, depth=2, dim=2).search,
    }
    for name, search in indexes.items():
        got = [tuple(r) for r in search(asked, 10, box).select("qid", "vec_id", "dist").orderBy("qid", "rank").collect()]
        assert got == [(0, 0, 0.0), (0, 1, 1.0), (0, 3, 9.0)], name
        got = [r.vec_id for r in search(asked, 10).orderBy("rank").collect()]
        assert got == [0, 4, 1, 2, 3], name
    far = FlatIndex(axes, 2).build(table).search(asked, 2, box, oversample=4)
    assert [r.vec_id for r in far.orderBy("rank").collect()] == [0, 1]
