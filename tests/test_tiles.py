"""Exact checks by blocks: after neighbour descent, after graph searches, and where many queries meet many rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, Polygon
from tessera.operators import cube as cubes
from tessera.operators import knn
from tessera.operators.cube import CubeIndex
from tessera.operators.filters import InBox, InPolygon
from tessera.operators.graph import neighbour_graph
from tessera.plans import tiles

from .test_graph import DIM, frame, true_edges
from .test_knn import rows_of


def isotropic(n, seed=0, groups=1):
    import pandas as pd

    rng = np.random.default_rng(seed)
    x, p = rng.normal(size=(n, DIM)).astype(np.float32), rng.random((n, 2)).astype(np.float32)
    return pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "a0": p[:, 0], "a1": p[:, 1], "grp": np.arange(n) % groups})


def questions(spark, df, every):
    return frame(spark, df[df.vec_id % every == 0]).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), F.col("a0").alias("q0"), F.col("a1").alias("q1"))


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("ROWS", 64), ("ASKS", 32), ("SLICE", 8)):
        monkeypatch.setattr(tiles, name, value)


def test_checked_descent_is_exact(spark, small_blocks):
    df = isotropic(300, 1, 3)
    edges = {(r.u, r.v) for r in neighbour_graph(frame(spark, df), 4, rounds=1, dim=DIM, checked=True).collect()}
    assert edges == true_edges(df, {(g, g) for g in range(3)}, 4)


def test_checked_graph_search_is_exact(spark, small_blocks):
    df = isotropic(600, 2)
    index = CubeIndex.build(frame(spark, df), ["a0", "a1"], layers=1, least_points=1, dim=DIM)
    asked, keep = questions(spark, df, 20), InBox(Box([F.col("q0") - 0.15, F.col("q1") - 0.15], [F.col("q0") + 0.15, F.col("q1") + 0.15]))
    truth = rows_of(knn.exact_knn(index.table, asked, 5, index.point, keep, DIM))
    graph = index.graph(0, m=4, rounds=1)
    starts = index.starts(asked, keep, 0)
    assert rows_of(graph.search(asked, starts, 5, keep, 5, width=5)) != truth
    assert rows_of(graph.search(asked, starts, 5, keep, 5, width=5, checked=True)) == truth


def test_many_queries_are_compared_by_blocks(spark, small_blocks, monkeypatch):
    df = isotropic(600, 3)
    base, asked = frame(spark, df), questions(spark, df, 5)
    point, box = [F.col("a0"), F.col("a1")], InBox(Box([F.col("q0") - 0.3, F.col("q1") - 0.3], [F.col("q0") + 0.3, F.col("q1") + 0.3]))
    keep = box | InPolygon(Polygon([(0.25, 0.125), (0.875, 0.25), (0.75, 0.875)]))
    truth = rows_of(knn.exact_knn(base, asked, 3, point, keep, DIM))
    for sample, enough in ((4, 2), (1, 8)):
        monkeypatch.setattr(knn, "FEW_QUERIES", 10)
        monkeypatch.setattr(knn, "SAMPLE", sample)
        monkeypatch.setattr(knn, "ENOUGH", enough)
        found = knn.exact_knn(base, asked, 3, point, keep, DIM)
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
        assert rows_of(found) == truth


@pytest.mark.parametrize("mode", ["cubes", "fly"])
def test_many_queries_of_a_cube_search(spark, small_blocks, monkeypatch, mode):
    df = isotropic(600, 4)
    index, asked = CubeIndex.build(frame(spark, df), ["a0", "a1"], layers=3, least_points=1, dim=DIM), questions(spark, df, 5)
    keep = InPolygon(Polygon([(0.25, 0.125), (0.875, 0.25), (0.75, 0.875), (0.375, 0.625)]))
    monkeypatch.setattr(cubes, "FEW_QUERIES", 10**6)
    monkeypatch.setattr(knn, "FEW_QUERIES", 10**6)
    truth = rows_of(index.search(asked, 3, keep, mode, 2))
    monkeypatch.setattr(cubes, "FEW_QUERIES", 10)
    monkeypatch.setattr(knn, "FEW_QUERIES", 10)
    monkeypatch.setattr(knn, "SAMPLE", 2)
    found = index.search(asked, 3, keep, mode, 2)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    assert rows_of(found) == truth


def test_a_reached_cube_is_settled_by_one_row(spark):
    df = isotropic(200, 5)
    index = CubeIndex.build(frame(spark, df), ["a0", "a1"], layers=2, least_points=1, dim=DIM)
    plan = index.reachable(questions(spark, df, 5), InPolygon(Polygon([(0.1, 0.1), (0.9, 0.1), (0.9, 0.9)])), 1)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan


def test_checked_forest_is_exact(spark, small_blocks):
    from tessera.llm.ann import nearest

    df = isotropic(500, 6)
    df.loc[7, "embedding"][:] = df.embedding[3]  # equal vectors
    x = np.stack(df.embedding.to_numpy()).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = []
    for q in range(0, 500, 10):
        score = u @ u[q]
        order = sorted((v for v in range(500) if v != q), key=lambda v: (-round(score[v], 12), v))[:5]
        want += [(q, r + 1, v, round(score[v], 6)) for r, v in enumerate(order)]
    for checked in (False, True):
        found = nearest(frame(spark, df), F.col("vec_id") % 10 == 0, trees=1, probes=1, candidates=20, checked=checked)
        got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in found.orderBy("query_id", "rank").collect()]
        assert (got == want) == checked


def test_samples_of_samples_keep_the_bounds_linear(spark, small_blocks, monkeypatch):
    met, pair = [], knn.paired
    monkeypatch.setattr(knn, "paired", lambda base, asked, *a: (met.append(base.count() * asked.count()), pair(base, asked, *a))[1])
    work = []
    for n in (600, 2400):
        df = isotropic(n, 7)
        base, asked = frame(spark, df), questions(spark, df, 5)
        monkeypatch.setattr(knn, "FEW_QUERIES", 10**6)
        truth = rows_of(knn.exact_knn(base, asked, 3, [], None, DIM))
        for name, value in (("FEW_QUERIES", 10), ("SAMPLE", 4), ("ENOUGH", 2), ("STEP", 4), ("PAIRS", 1)):
            monkeypatch.setattr(knn, name, value, raising=False)
        met.clear()
        assert rows_of(knn.exact_knn(base, asked, 3, [], None, DIM)) == truth
        work.append(sum(met))
    # four times the rows and queries: pairs that are not compared by blocks grow as the queries, not as all pairs
    assert work[1] < 8 * work[0]


def test_queries_are_dealt_out_to_a_small_sample(spark, small_blocks, monkeypatch):
    df = isotropic(600, 8)
    base, asked = frame(spark, df), questions(spark, df, 5)
    point, box = [F.col("a0"), F.col("a1")], InBox(Box([F.col("q0") - 0.3, F.col("q1") - 0.3], [F.col("q0") + 0.3, F.col("q1") + 0.3]))
    truth = [rows_of(knn.exact_knn(base, asked, 3, point, keep, DIM)) for keep in (box, None)]
    for name, value in (("FEW_QUERIES", 10), ("MOST_BROADCAST", 40), ("SAMPLE", 4), ("ENOUGH", 2), ("STEP", 4), ("PAIRS", 1)):
        monkeypatch.setattr(knn, name, value)
    assert [rows_of(knn.exact_knn(base, asked, 3, point, keep, DIM)) for keep in (box, None)] == truth
