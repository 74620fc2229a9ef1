"""Vector code compression: product codes of four parts, their codebooks made by Elkan's form of Lloyd's rounds.

Components become integers, so that every distance is exact. Each round's table keeps, for each part of a
vector, its entry, an upper bound of the distance to it and a lower bound of the distance to every entry, all
in whole units: upper bounds rounded up, lower ones down (and cut at 65,535, which leaves them lower bounds).
When entries move, upper bounds grow and lower bounds shrink by the movement, rounded up. An entry is left out
for a part only if its lower bound, or half its distance from the part's entry, is strictly greater than the
upper bound; all others are compared by exact integer distances, ties to the lower index, so the result is
that of comparing all. Tasks add up their parts by entry; only these sums, of at most 4 * 256 entries, reach
the driver, which makes the next codebooks from them.

A round's table holds 2 bytes for each part and entry beside the vector: 2 KB a vector. The table before it is
deleted as soon as the next is written.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite components are left out;
vectors of several lengths, of a length that 4 does not divide, or of components so large that squared
distances do not fit a long are an error that says so; with fewer than 256 rows kept there are as many
entries; rows without a vec_id come last for the first codebook, of rows with equal ids the smaller vector
comes first; rows that repeat take part like any other; null labels count as one; an empty table gives an
empty one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, scratch, shared_dir, ship_code, with_hot, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors whose bounds are worked on at once, and pairs of part and entry compared at once.
SLICE = 2048
PAIRS = 1 << 18
MOST_LOWER = 65535

Batches = Iterator[pa.RecordBatch]
STATE = "vec_id long, label string, x binary, code binary, upper binary, lower binary"


def floor_sqrt(x: np.ndarray) -> np.ndarray:
    r = np.floor(np.sqrt(x.astype(np.float64))).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def ceil_sqrt(x: np.ndarray) -> np.ndarray:
    r = floor_sqrt(x)
    return r + (r * r < x)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to each entry: exact."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # whole numbers that a double holds: products may go through BLAS
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        gap = x[:, None, k] - book[None, :, k]
        out += gap * gap
    return out


def own_distances(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    gap = x - book[code]
    return (gap * gap).sum(1)


def first_bounds(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper bound and lower bounds of each row by comparing all."""
    d = distances(x, book)
    code = d.argmin(1)
    return code, ceil_sqrt(d[np.arange(len(x)), code]), np.minimum(floor_sqrt(d), MOST_LOWER)


def next_bounds(x: np.ndarray, book: np.ndarray, between: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries have moved (`moved`, rounded up), and how many pairs were compared.

    between: distances of the entries from each other, rounded down.
    """
    upper = upper + moved[code]
    lower = np.maximum(lower - moved, 0)
    own = np.arange(len(book)) == code[:, None]
    open_ = (lower <= upper[:, None]) & (between[code] <= 2 * upper[:, None]) & ~own
    rows = np.flatnonzero(open_.any(1))
    if not len(rows):
        return code, upper, lower, 0
    code, lower = code.copy(), lower.copy()
    before = code[rows]
    exact = own_distances(x[rows], book, before)
    upper[rows] = ceil_sqrt(exact)
    lower[rows, before] = np.minimum(floor_sqrt(exact), MOST_LOWER)
    still = open_[rows] & (lower[rows] <= upper[rows, None]) & (between[before] <= 2 * upper[rows, None])
    r, j = np.nonzero(still)
    d = np.full(still.shape, np.iinfo(np.int64).max, np.int64)
    d[np.arange(len(rows)), before] = exact
    for a in range(0, len(r), PAIRS):
        i, e = r[a : a + PAIRS], j[a : a + PAIRS]
        gap = x[rows[i]] - book[e]
        d[i, e] = (gap * gap).sum(1)
    lower[rows[r], j] = np.minimum(floor_sqrt(d[r, j]), MOST_LOWER)
    best = d.argmin(1)
    code[rows] = best
    upper[rows] = ceil_sqrt(d[np.arange(len(rows)), best])
    return code, upper, lower, len(r) + len(rows)


def whole_numbers(batches: Batches) -> Batches:
    """Vectors as little-endian 64-bit integers floor(SCALE * component)."""
    for batch in batches:
        v = batch.column("embedding")
        flat = np.floor(v.flatten().to_numpy(zero_copy_only=False) * SCALE).astype("<i8")
        ends = np.cumsum(np.asarray(v.value_lengths()))
        x = [flat[a:b].tobytes() for a, b in zip((ends - np.asarray(v.value_lengths())).tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(x, pa.binary())], ["vec_id", "label", "x"])


def matrix(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def binaries(values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def assign(batches: Batches, books: np.ndarray, between: np.ndarray | None, moved: np.ndarray | None, last: bool = False) -> Batches:
    """The state after one more assignment; `last`: the codes and errors instead."""
    parts, k, width = books.shape
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            x = matrix(batch.column("x"), "<i8", parts, width)
            code = np.zeros((len(x), parts), np.int64)
            upper, lower = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts, k), np.int64)
            if between is None:
                for p in range(parts):
                    code[:, p], upper[:, p], lower[:, p] = first_bounds(x[:, p], books[p])
            else:
                c, u = matrix(batch.column("code"), "u1", parts).astype(np.int64), matrix(batch.column("upper"), "<i8", parts)
                low = matrix(batch.column("lower"), "<u2", parts, k).astype(np.int64)
                for p in range(parts):
                    code[:, p], upper[:, p], lower[:, p], _ = next_bounds(x[:, p], books[p], between[p], moved[p], c[:, p], u[:, p], low[:, p])
            keys = [batch.column("vec_id"), batch.column("label")]
            if last:
                error = sum(own_distances(x[:, p], books[p], code[:, p]) for p in range(parts))
                digits = pa.array([c.tobytes().hex() for c in code.astype("u1")], pa.string())
                yield pa.RecordBatch.from_arrays([*keys, digits, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
            else:
                state = [batch.column("x"), binaries(code.astype("u1")), binaries(upper.astype("<i8")), binaries(lower.astype("<u2"))]
                yield pa.RecordBatch.from_arrays([*keys, *state], ["vec_id", "label", "x", "code", "upper", "lower"])


def add_up(batches: Batches, parts: int, k: int, width: int) -> Batches:
    """One row for each part and entry that the task's rows use: their number and sums."""
    sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x, code = matrix(batch.column("x"), "<i8", parts, width), matrix(batch.column("code"), "u1", parts)
        for p in range(parts):
            np.add.at(sums[p], code[:, p], x[:, p])
            counts[p] += np.bincount(code[:, p], minlength=k)
    p, e = np.nonzero(counts)
    s = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * width + 1, max(width, 1), dtype=np.int32)[: len(p) + 1]), pa.array(sums[p, e].reshape(-1)))
    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), s], ["part", "entry", "n", "s"])


def moved_books(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries at the floor of their parts' mean, their distances from each other and how far they moved."""
    parts, k, width = books.shape
    sums = state.select("x", "code").mapInArrow(lambda x: add_up(x, parts, k, width), "part int, entry int, n long, s array<long>")
    total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)))
    new = books.copy()
    for row in total.collect():  # PARTS * ENTRIES rows at most
        new[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    gap = new - books
    between = np.stack([floor_sqrt(distances(b, b)) for b in new])
    return new, between, ceil_sqrt((gap * gap).sum(2))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label as a string, code, error for every vector kept; the codebooks by part, entry, position).

    code: an entry a part, two hexadecimal digits each. error: squared distance to what the code stands for.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code's digits hold 256 entries at most")
    spark = vectors.sparkSession
    ship_code(spark)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("embedding"))
    rows = rows.where("size(embedding) > 0").where(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)))
    sizes = rows.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("most")).first()
    if sizes["a"] is None:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    if sizes["a"] != sizes["b"] or sizes["a"] % parts:
        raise ValueError(f"vectors have {sizes['a']} to {sizes['b']} components: they need one length that {parts} divides")
    if 4 * (SCALE * sizes["most"] + 1) ** 2 * sizes["a"] >= 1 << 62:
        raise ValueError("squared distances between these vectors do not fit a long")
    width = sizes["a"] // parts
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    books = np.array([[math.floor(SCALE * c) for c in r[0]] for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    state, between, moved, old = rows.mapInArrow(whole_numbers, "vec_id long, label string, x binary"), None, None, None
    for _ in range(rounds):
        path = shared_dir(spark, f"bounds-{uuid.uuid4().hex}")
        state.mapInArrow(lambda x, a=books, b=between, c=moved: assign(x, a, b, c), STATE).write.parquet(path)
        if old:
            remove(spark, old)
        state, old = spark.read.schema(STATE).parquet(path), path
        books, between, moved = moved_books(state, books)
    out = written(state.mapInArrow(lambda x: assign(x, books, between, moved, True), "vec_id long, label string, code string, error long"), "codes")
    if old:
        remove(spark, old)
    return out, books


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """`codes` with label_error: error summed over the rows of a label. Sums are made in part before the
    shuffle, and labels in a share of all rows get theirs by broadcast."""
    keyed = codes.withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = written(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return with_hot(keyed, sums.select("key", "label_error"), "key", hot_keys(sums)).drop("key")


def coded(vectors: DataFrame) -> DataFrame:
    spark = vectors.sparkSession
    path = shared_dir(spark, "vector-codes")
    with scratch(spark, "vector-codes"):
        codes, books = vector_codes(vectors)
        out = with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(dim: int = 64) -> str:
    """The same rounds spelled out, comparing all."""
    w = dim // PARTS
    gap = " + ".join(f"(v.x[{i}] - b.c[{i}]) * (v.x[{i}] - b.c[{i}])" for i in range(1, w + 1))
    out = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::double) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, p, x[p * {w} + 1 : p * {w} + {w}] AS x FROM k, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, x AS c FROM v QUALIFY e < {ENTRIES})"""
    for r in range(ROUNDS + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT v.p, v.vec_id, min(({gap}) * {ENTRIES} + b.e) AS best FROM v JOIN b{r} b USING (p) GROUP BY ALL)"""
        if r < ROUNDS:
            mean = ", ".join(f"CAST(floor(sum(v.x[{i}]) / count(*)) AS BIGINT)" for i in range(1, w + 1))
            out += f""",
m{r} AS (SELECT p, best % {ENTRIES} AS e, [{mean}] AS c FROM a{r} JOIN v USING (p, vec_id) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e))"""
    return out + f""",
f AS (SELECT vec_id, string_agg(format('{{:02x}}', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
l AS (SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM f JOIN k USING (vec_id))
SELECT *, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM l"""


OP11_SQL = _sql()
