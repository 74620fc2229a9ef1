"""Many queries: one read of the base, bounds from a sample, against comparing all."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.geometry import Box
from tessera.operators import knn as module
from tessera.operators.cube import CubeIndex
from tessera.operators.evaluate import selectivity
from tessera.operators.filters import Everything, InBox
from tessera.operators.knn import exact_knn, post_filter


def tables(spark, n=400, asked=90, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([1.0, 4.0]) * rng.choice([0.0, 0.5, 1.0]) for _ in range(3)], rng.random()) for i in range(n)]
    queries = [(1000 + i, [rng.random() * 3 for _ in range(3)], rng.random()) for i in range(asked)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, m0 float"), spark.createDataFrame(queries, "qid long, qv array<float>, q0 float")


def brute(base, queries, k, near):
    out = []
    rows = base.collect()
    for q in queries.collect():
        found = sorted((sum((a - b) ** 2 for a, b in zip(r.embedding, q.qv)), r.vec_id) for r in rows if near(r, q))[:k]
        out += [(q.qid, i + 1, v, round(d, 9)) for i, (d, v) in enumerate(found)]
    return out


def rows_of(df):
    return [(r.qid, r.rank, r.vec_id, round(r.dist, 9)) for r in df.orderBy("qid", "rank").collect()]


@pytest.mark.parametrize("most, few, sample", [(4096, 64, 8), (10, 64, 8), (10, 1, 1000), (4096, 10**6, 1)])
def test_every_way_gives_the_same(spark, monkeypatch, most, few, sample):
    for name, value in (("MOST_BROADCAST", most), ("FEW_QUERIES", few), ("SAMPLE", sample)):
        monkeypatch.setattr(module, name, value)
    base, queries = tables(spark)
    box = InBox(Box([F.col("q0") - 0.1], [F.col("q0") + 0.1]))
    point = [F.col("m0")]
    found = exact_knn(base, queries, 5, point, box, 3)
    kept = base.join(queries, box.column(point)).select("vec_id", "qid").collect()
    passes = {(r.vec_id, r.qid) for r in kept}
    assert rows_of(found) == brute(base, queries, 5, lambda r, q: (r.vec_id, q.qid) in passes)
    assert rows_of(exact_knn(base, queries, 3, point)) == brute(base, queries, 3, lambda r, q: True)
    far = brute(base, queries, 12, lambda r, q: True)
    want = {}
    for qid, _, v, d in far:
        if (v, qid) in passes:
            want.setdefault(qid, []).append((v, d))
    want = [(q, i + 1, v, d) for q in sorted(want) for i, (v, d) in enumerate(want[q][:3])]
    assert rows_of(post_filter(base, queries, 3, point, box, 4, 3)) == want
    share = {r.qid: r.passed for r in selectivity(base, queries, point, box).collect()}
    assert share == {q.qid: sum(1 for p in passes if p[1] == q.qid) for q in queries.collect()}


def test_the_base_is_read_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(module, "MOST_BROADCAST", 10)
    monkeypatch.setattr(module, "FEW_QUERIES", 10**6)
    base, queries = tables(spark)
    base.write.parquet(str(tmp_path / "base"))
    found = exact_knn(spark.read.parquet(str(tmp_path / "base")), queries, 5, [F.col("m0")], Everything(), 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("embedding#") and plan.count("Relation [") == 1
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_watched_search_counts_in_the_same_pass(spark):
    base, queries = tables(spark)
    index = CubeIndex.build(base, ["m0"], layers=3, least_points=1, dim=3)
    box = InBox(Box([F.col("q0") - 0.1], [F.col("q0") + 0.1]))
    found, watch = index.watched(queries, 5, box)
    got = rows_of(found)
    assert got == rows_of(index.search(queries, 5, box))
    done = watch.averages()
    second = index.metrics(queries, box).agg(F.avg("visited"), F.avg("distances")).first()
    assert done["visited"] == pytest.approx(second[0]) and done["distances"] == pytest.approx(second[1])
    assert done["selectivity"] == pytest.approx(second[1] / 400) and watch.per_second(2) == 45
