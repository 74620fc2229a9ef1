"""Vector codes against Lloyd's rounds that compare all."""

import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm.codes import OP11_SQL, books_digest, ceil_sqrt, coded, distances, first_bounds, floor_sqrt, next_bounds, vector_codes, with_label_errors


def brute(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label). The same rows with code, error, label_error, and the digest."""
    kept = [(i, [math.floor(1024 * c) for c in v], lab) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for turn in range(rounds + 1):
        found = [[near(part(v, p), books[p]) for p in range(4)] for _, v, _ in kept]
        if turn == rounds:
            break
        for p in range(4):
            for k in range(len(books[p])):
                own = [part(v, p) for (_, v, _), f in zip(kept, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, lab), e in zip(kept, errors):
        sums[lab] = sums.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i if i is not None else -1), "".join(f"{k:02x}" for _, k in f), e, sums[lab], digest) for (i, _, lab), f, e in zip(kept, found, errors))


def rows_of(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_odd_rows_ties_and_negatives(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-3, 4) / 512 for _ in range(8)], rng.choice([None, 1, 2])) for i in range(700)]
    rows += [(3, rows[10][1], 1), (4, rows[4][1], 2), (None, rows[9][1], None)]
    rows += [(900, None, 1), (901, [], 1), (902, [math.nan] + [0.0] * 7, 1), (903, [math.inf] + [0.0] * 7, 2), (904, [None] + [0.0] * 7, 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' AS code", "1 AS x", "2 AS n", "'k' AS key", "0 AS error")
    assert rows_of(coded(df)) == brute(rows)


@pytest.mark.parametrize("spread", [0.01, 0.3])
def test_clustered(spark, spread):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    vectors = (centers[rng.integers(0, 12, 900)] + spread * rng.normal(size=(900, 16))).astype(np.float32)
    rows = [(i * 7 % 901, v.tolist(), i % 5) for i, v in enumerate(vectors)]
    assert rows_of(coded(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_few_entries_and_rounds(spark):
    rows = [(i, [float(i % 3), float(i % 5), 0.5, -0.25], None) for i in range(40)]
    codes, books = vector_codes(spark.createDataFrame(rows, SCHEMA), entries=7, rounds=2)
    got = with_label_errors(codes).collect()
    want = brute(rows, 7, 2)
    assert sorted((r.vec_id, r.code, r.error, r.label_error, books_digest(books)) for r in got) == want


def test_empty_and_refused(spark):
    assert coded(spark.createDataFrame([], SCHEMA)).count() == 0
    assert coded(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], [(1, [1.0] * 6, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(ValueError):
            coded(spark.createDataFrame(bad, SCHEMA))


def test_bounds_hold_and_prune():
    """What is left out is strictly farther, and much is left out where entries move little."""
    rng = np.random.default_rng(0)
    centers = rng.integers(-4000, 4000, (64, 8))
    x = centers[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 8))
    book = centers + rng.integers(-20, 20, centers.shape)
    code, upper, lower = first_bounds(x, book)
    new = book + rng.integers(-5, 5, book.shape)
    moved, between = ceil_sqrt(((new - book) ** 2).sum(1)), floor_sqrt(distances(new, new))
    code, upper, lower, compared = next_bounds(x, new, between, moved, code, upper, lower)
    d = distances(x, new)
    assert (code == d.argmin(1)).all()
    assert (upper * upper >= d.min(1)).all() and (lower * lower <= d).all()
    assert compared < 0.1 * d.size


def test_exact_roots_and_distances():
    n = np.array([0, 1, 2, 3, 4, (1 << 31) ** 2 - 1, (1 << 31) ** 2, 10**18 + 1])
    assert floor_sqrt(n).tolist() == [math.isqrt(int(v)) for v in n]
    assert ceil_sqrt(n).tolist() == [math.isqrt(int(v) - 1) + 1 if v else 0 for v in n]
    far = np.array([[1 << 27, -(1 << 27)]])
    assert distances(far, -far).tolist() == [[2 * (1 << 28) ** 2]]


def test_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({OP11_SQL})").fetchall()
    assert rows_of(coded(spark.read.parquet(f"{sf}/embeddings.parquet"))) == sorted(want)
