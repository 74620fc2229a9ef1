"""Which boxes of one table meet which of another, without comparing all of them, and ranges of what was met."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, both, single

#: Cells along an axis at most, and the error of the quantiles at which they are cut.
MOST_CELLS = 256
QUANTILE_ERROR = 0.002
#: Ranges that a search names to the reader at most.
MOST_RANGES = 64


def cell(value: Column, cuts: list[float]) -> Column:
    """How many cuts are no greater than the value: a cell along an axis."""
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<double>"), lambda c: c <= value))


def meeting(boxes: DataFrame, axes: list[str], queries: DataFrame, box: Box) -> DataFrame:
    """The rows of `queries` beside the rows of `boxes` (lo_a and hi_a for each axis a) that their box meets;
    closed: boxes that touch meet.

    Both are listed in the cells that they cover and joined on them; a pair is taken only in the cell of the
    lower corner of what they share. Cells are cut at quantiles of the boxes, so that crowded places have
    small ones, about as many in all as there are boxes.
    """
    used = [(a, lo, hi) for a, lo, hi in zip(axes, box.lo, box.hi)]
    n = max(1, boxes.count())
    along = max(1, min(MOST_CELLS, math.ceil(n ** (1 / len(used)))))
    steps = [k / along for k in range(1, along)]
    wide = boxes.select(*(F.col(f"lo_{a}").cast("double").alias(a) for a, _, _ in used))
    found = wide.approxQuantile([a for a, _, _ in used], steps, QUANTILE_ERROR) if steps else [[] for _ in used]
    cuts = [sorted(set(c)) for c in found]

    def listed(df: DataFrame, spans: list[tuple[Column, Column]]) -> DataFrame:
        for i, ((lo, hi), c) in enumerate(zip(spans, cuts)):
            df = df.withColumn(f"cell{i}_", F.explode(F.sequence(cell(lo, c), cell(hi, c))))
        return df

    own = [(F.col(f"lo_{a}").cast("double"), F.col(f"hi_{a}").cast("double")) for a, _, _ in used]
    asked = [(F.col(f"from{i}_"), F.col(f"to{i}_")) for i in range(len(used))]
    bounded = queries.withColumns({f"{n}{i}_": single(x) for i, (_, lo, hi) in enumerate(used) for n, x in (("from", lo), ("to", hi))})
    bounded = bounded.where(both([a <= b for a, b in asked]))
    cells = [f"cell{i}_" for i in range(len(used))]
    pairs = listed(boxes, own).join(listed(bounded, asked), cells)
    test = both([(b >= c) & (a <= d) & (F.col(f"cell{i}_") == cell(F.greatest(a, c), cuts[i])) for i, ((a, b), (c, d)) in enumerate(zip(own, asked))])
    return pairs.where(test).drop(*cells, *(f"{n}{i}_" for i in range(len(used)) for n in ("from", "to")))


def named_ranges(met: DataFrame, first: str, last: str) -> list[tuple[int, int]]:
    """At most MOST_RANGES ranges that hold all of the rows' ranges [first, last]; only their bounds reach the driver."""
    bounds = met.agg(F.min(first), F.max(last)).first()
    if bounds[0] is None:
        return []
    step = (bounds[1] - bounds[0]) // MOST_RANGES + 1
    parts = met.groupBy(F.floor((F.col(first) - bounds[0]) / step).alias("part")).agg(F.min(first).alias("a"), F.max(last).alias("b"))
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in parts.collect()):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def within(df: DataFrame, column: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """The rows in any of the ranges: a predicate that reaches the Parquet reader's statistics."""
    test = F.lit(False)
    for a, b in ranges:
        test = test | F.col(column).between(a, b)
    return df.where(test)
