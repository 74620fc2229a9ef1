"""Neighbours, decontamination, languages and toxicity; held-out accuracy where nothing exact exists."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann
from tessera.llm.ann import FEW_SQL, ann_of_few, ascend, nearest, op1_ann, ranges, spread
from tessera.llm.decontam import decontaminate, find_leaks, lcs
from tessera.llm.lang_id import identify, learn, op7_lang_id
from tessera.llm.toxicity import best_threshold, judge, op8_toxicity, score, train


def test_nearest_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(table.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = table.vec_id.to_numpy()
    got = op1_ann(spark, sf).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        order = [v for _, v in sorted(zip(-s, ids)) if v != q][:5]
        hits += len(set(order) & set(own.vec_id))
        assert list(own.sort_values("rank").score) == sorted(own.score, reverse=True)
    assert got.query_id.nunique() == (ids % 50 == 0).sum() and hits >= 0.95 * len(got)


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(20)]
    rows += [(50, rows[50][1]), (900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [1.0]), (None, rows[1][1]), (905, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "tree": F.lit(2)})
    got = nearest(df, F.col("vec_id") % 50 == 0, probes=8).toPandas()
    assert set(got.query_id) == {0, 50, 100, 150, 300} and (got.groupby("query_id").size() == 5).all()
    assert not set(got.vec_id) & {900, 901, 902, 903, 904, 905}
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == [300, 301, 302, 303, 304]
    assert list(got[got.query_id == 300].sort_values("rank").vec_id) == [0, 301, 302, 303, 304]
    assert nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = nearest(df.where("vec_id in (0, 1)"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in few] == [1]


def brute_neighbours(x, ids, queries, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        score = np.round(unit @ unit[ids == q][0], 12)
        out[q] = [int(v) for _, v in sorted(zip(-score, ids)) if v != q][:k]
    return out


@pytest.mark.parametrize("kind", ["one-hot", "signs", "doubles"])
def test_ties_go_to_the_smaller_id(spark, kind):
    rng = np.random.default_rng(9)
    if kind == "one-hot":
        x = np.eye(40)
    elif kind == "signs":
        x = rng.choice([-1.0, 1.0], (400, 6))
    else:  # apart only beyond single precision
        x = np.tile(rng.normal(size=(1, 8)), (60, 1))
        x[:, 0] += rng.permutation(60) * 1e-11
        x[50:] = rng.normal(size=(10, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append(r.vec_id)
    if kind == "doubles":
        assert all(r.score > 0.99999999 for r in got if r.query_id < 50) and len({tuple(v) for v in x}) == 60
    else:
        assert found == brute_neighbours(x, np.arange(len(x)), range(0, len(x), 10))


def test_few_vectors_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(FEW_SQL).df()
    assert sorted(map(tuple, ann_of_few(spark, sf).select(*want.columns).collect())) == sorted(map(tuple, want.itertuples(index=False)))


def test_candidates_bound_the_vectors_scored(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16))
    x = centers[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").cache()
    asks = F.col("vec_id") % 50 == 0
    want = brute_neighbours(x, np.arange(3000), range(0, 3000, 50))

    def recall(rows):
        return sum(r.vec_id in want[r.query_id] for r in rows) / 300

    for bits in (0, 4):  # one shard a tree, and many
        monkeypatch.setattr(ann, "shard_bits", lambda n, bits=bits: bits)
        shares = []
        for enough in (30, 300, 1500):
            rows = nearest(df, asks, candidates=enough).collect()
            assert 0 < max(r.scored for r in rows) <= enough
            shares.append(recall(rows))
        assert shares == sorted(shares) and shares[0] < shares[2] and shares[2] >= 0.95
    assert recall(nearest(df, asks, candidates=ann.TREES * 3000).collect()) == 1.0


@pytest.mark.parametrize("kind,n", [("isotropic", 500), ("isotropic", 2000), ("isotropic", 6000), ("clustered", 2000), ("clustered", 6000)])
def test_recall_at_default_settings(spark, kind, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    if kind == "clustered":
        x = rng.normal(size=(30, 64))[rng.integers(0, 30, n)] + 0.4 * x
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute_neighbours(x, np.arange(n), range(0, n, 50))
    rows = nearest(df, F.col("vec_id") % 50 == 0).collect()
    recall, scored = sum(r.vec_id in want[r.query_id] for r in rows) / len(rows), max(r.scored for r in rows) / n
    print(f"{kind} {n}: recall {recall:.3f}, {scored:.2f} scored at most")
    assert len(rows) == 5 * len(want) and recall >= 0.9 and scored < 1


def test_vectors_of_one_string_are_all_gathered():
    # more than `candidates` agree in all bits: none is left out
    seen = [{"tree": t, "shard": 0, "counts": [1000, 400, 300], "codes": [1]} for t in range(2)]
    row = {"query": 1, "seen": seen}
    assert [x[4:] for x in ascend(row, [0, 5, 64], 0, 500, np.full((2, 1), 1000))] == [(64, 64, 0)] * 2
    assert [x[4:] for x in ascend(row, [0, 5, 64], 0, 700, np.full((2, 1), 1000))] == [(64, 5, 50)] * 2
    assert [x[4:] for x in ascend(row, [0, 5, 64], 0, 1000, np.full((2, 1), 1000))] == [(5, 0, 100)] * 2
    assert [x[1:3] + x[4:] for x in ascend(row, [0, 5, 64], 0, 2000, np.full((2, 1), 1000))] == [(0, 0, 0, 0, 0)]
    a = np.array([5, 5, 5, 8], np.uint64)
    lo, hi = ranges(a, np.array([5, 5, 6], np.uint64), 64)
    assert spread(lo, hi).tolist() == [0, 1, 2] and spread(*ranges(a, a, 0)).tolist() == [0, 1, 2, 3]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_subsequence_against_a_table():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 70)), rng.integers(0, 6, rng.integers(0, 90))
        assert lcs(a.astype(np.uint64), b.astype(np.uint64)) == plain_lcs(a.tolist(), b.tolist())


def test_leaks_are_found_and_clean_documents_stay(spark, make_text):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    text = lambda n: " ".join(rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.4 else word() for _ in range(n))
    items = {i: text(rng.randrange(15, 60)) + "." for i in range(12)}
    docs, leaked = {}, set()
    for d in range(150):
        body = text(rng.randrange(30, 300)).split()
        if d % 5 == 0:
            i = (d // 5) % 12
            put = items[i].split()
            if d % 15 == 0:  # a paraphrase: one word in nine is another, case and commas differ
                put = [w.upper() + "," if k % 4 else w for k, w in enumerate(put)]
                put = [word() if k % 9 == 4 else w for k, w in enumerate(put)]
            at = rng.randrange(len(body))
            body[at:at] = put
            leaked.add((d, i))
        docs[d] = " ".join(body)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, lang string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaked
    assert all(0 <= r.start < r.end <= len(docs[r.doc_id]) for r in found)
    kept = decontaminate(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(docs) - {d for d, _ in leaked}


def test_leaks_odd_rows(spark, odd_documents):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a plain short text about rivers and very many stones")], "item_id long, text string")
    assert find_leaks(odd_documents, bench).where("doc_id not in (1, 6)").count() == 0
    assert decontaminate(odd_documents, bench.limit(0)).count() == 9
    assert find_leaks(odd_documents.limit(0), bench).count() == 0


def test_languages_on_held_out_rows(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_lang_id(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and held and all(0 <= r.score <= 1 for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.93 * len(held)


def test_languages_odd_rows(odd_documents):
    known = learn(odd_documents)
    got = {(r.doc_id, r.best) for r in identify(odd_documents, known).collect()}
    assert {(2, "und"), (3, "und"), (5, "und")} <= got and len(identify(odd_documents, known).collect()) == 9
    assert {r.lang_pred for r in identify(odd_documents, {}).collect()} == {"und"}
    assert learn(odd_documents.limit(0)) == {}


def test_toxicity_learns_words(spark, make_text):
    rng = random.Random(8)
    rows = []
    for i in range(700):
        bad = i % 4 == 0
        words = make_text(rng, rng.randrange(5, 120)).split()
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["gruftig", "blarp", "Snodge!"])
        rows.append((" ".join(words), int(bad), "en" if i % 2 else "de"))
    frame = pd.DataFrame(rows, columns=["text", "toxic", "lang"])
    model = train(frame[:500], epochs=6)
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score(df, model).collect()}
    right = sum((got[i] >= 0.7) == bool(rows[i][1]) for i in range(500, 700))
    assert right >= 190 and all(0 <= s <= 1 for s in got.values())
    assert {r.doc_id for r in judge(df, model).collect()} == {i for i, s in got.items() if s < 0.7}


def test_toxicity_odd_rows(spark, odd_documents):
    one = train(pd.DataFrame({"text": ["a", "b"], "toxic": [0, 0], "lang": [None, "en"]}))
    none = train(pd.DataFrame({"text": [], "toxic": [], "lang": []}))
    for model in (one, none):
        got = score(odd_documents, model).collect()
        assert len(got) == 9 and all(0 <= r.score < 0.7 for r in got)
    assert judge(odd_documents, one).count() == 9
    assert 0.02 <= best_threshold(np.array([0.9, 0.1]), np.array([1.0, 0.0])) <= 0.98


def test_toxicity_query(spark, sf):
    got = op8_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
