"""All pairs of two tables that lie within a distance, compared block by block.

A block of rows meets a block of queries as one product of matrices, so a pair costs a few nanoseconds; only pairs
within the query's own bound leave the task, with their distance summed up as `l2sq` does it. Rows are read once and
copied to each block of queries; no task holds more than one block of either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ship_code

#: Rows and queries of a block, and queries that are compared with a block at a time.
ROWS, ASKS, SLICE = 4096, 2048, 64
#: A product of matrices differs from the sum of squares by less than this share of both vectors' squares.
ROUNDING = 1e-12
#: Bounds are let out by this much: sums in another order are rounded otherwise.
SLACK = 1 + 1e-9


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distance of a[i] and b[j], component after component."""
    out = np.zeros(len(i))
    for x, y in zip(a.T, b.T):
        gap = x[i] - y[j]
        out += gap * gap
    return out


def compare(asked: pa.Table, rows: pa.Table, names: list[str]) -> pa.Table:
    """The columns `names` of both sides and dist, for all pairs within the query's tau_."""
    i, j, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(asked) and len(rows):
        a, b = vectors_of(asked.column("qv")), vectors_of(rows.column("embedding"))
        with np.errstate(invalid="ignore", over="ignore"):
            tau, square_a, square_b = asked.column("tau_").to_numpy(), (a * a).sum(1), (b * b).sum(1)
            # |a|^2 - 2ab + |b|^2 <= tau, with what rounding may take
            left, right = np.c_[-2 * a, np.ones(len(a))], np.c_[b, square_b * (1 - ROUNDING)].T
            most = (tau - square_a * (1 - ROUNDING))[:, None]
            for at in range(0, len(a), SLICE):
                some = slice(at, at + SLICE)
                x, y = np.divmod(np.flatnonzero(left[some] @ right <= most[some]), len(b))
                x += at
                exact = distances(a, b, x, y)
                near = exact <= tau[x]
                i.append(x[near])
                j.append(y[near])
                dist.append(exact[near])
    i, j = pa.array(np.concatenate(i)), pa.array(np.concatenate(j))
    columns = [asked.column(c).take(i) if c in asked.schema.names else rows.column(c).take(j) for c in names]
    return pa.table([*columns, pa.array(np.concatenate(dist))], [*names, "dist"])


def within(rows: DataFrame, asked: DataFrame, key: str | None = None) -> DataFrame:
    """The rows (vec_id, embedding, ...) beside each query (qid, qv, tau_, ...) that lie no farther than tau_, with
    dist; without the vectors and tau_. key: a column that both have, whose values have to be equal.

    Vectors have to be sound and of one length. An infinite bound lets all through.
    """
    spark = rows.sparkSession
    ship_code(spark)
    on = [key] if key else []
    rows = rows if key else rows.withColumn("all_", F.lit(0))
    asked = asked if key else asked.withColumn("all_", F.lit(0))
    by = key or "all_"
    # blocks of each group: one row a value of the key
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("rows_")).join(
        asked.groupBy(by).agg(F.ceil(F.count("*") / ASKS).cast("int").alias("asks_")), by
    )
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, by).withColumns({"i_": place("qid", "asks_"), "j_": every("rows_")})
    right = rows.join(sizes, by).withColumns({"j_": place("vec_id", "rows_"), "i_": every("asks_")})
    kept = {f.name: f for f in [*asked.schema.fields, *rows.schema.fields] if f.name not in ("qv", "tau_", "embedding", "all_")}
    schema = T.StructType([*kept.values(), T.StructField("dist", T.DoubleType())])
    of = lambda df, extra: [c for c in df.columns if c in kept or c in extra]
    # both sides may stem from one table: new names, else Spark cannot tell their columns apart
    left = left.select(*(F.col(c).alias(c) for c in of(asked, ("qv", "tau_", "all_"))), F.col("i_").alias("i_"), F.col("j_").alias("j_"))
    right = right.select(*(F.col(c).alias(c) for c in of(rows, ("embedding", "all_"))), F.col("i_").alias("i_"), F.col("j_").alias("j_"))
    names, cells = list(kept), [*(on or ["all_"]), "i_", "j_"]
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(lambda a, b: compare(a, b, names), schema)
