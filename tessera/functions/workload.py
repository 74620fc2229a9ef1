"""Synthetic attribute points and random filters."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DISTRIBUTIONS = ("uniform", "normal", "clustered", "skewed", "hollow")
# Parameters of the distributions.
NORMAL_MEAN, NORMAL_SD = 0.5, 0.15
CLUSTERS, CLUSTER_LOW, CLUSTER_HIGH, CLUSTER_SD = 5, 0.1, 0.9, 0.05
SHELL_INNER, SHELL_OUTER = 0.2, 0.5


def clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def attribute_points(spark: SparkSession, kind: str, n: int, dims: int, seed: int = 42) -> DataFrame:
    """vec_id and m0 ... of n points in the unit cube."""
    if kind not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution {kind}; known: {', '.join(DISTRIBUTIONS)}")
    rows = spark.range(n).withColumnRenamed("id", "vec_id")
    axes = range(dims)
    if kind == "uniform":
        values = [F.rand(seed + a) for a in axes]
    elif kind == "normal":
        values = [clip(F.randn(seed + a) * NORMAL_SD + NORMAL_MEAN) for a in axes]
    elif kind == "clustered":
        rng = random.Random(seed)
        centers = [[rng.uniform(CLUSTER_LOW, CLUSTER_HIGH) for _ in axes] for _ in range(CLUSTERS)]
        which = F.least(F.floor(F.col("vec_id") * CLUSTERS / n), F.lit(CLUSTERS - 1)).cast("int")
        values = [clip(F.element_at(F.array(*(F.lit(c[a]) for c in centers)), which + 1) + F.randn(seed + a) * CLUSTER_SD) for a in axes]
    elif kind == "skewed":  # Beta(1/2, 1/2): high at both ends
        values = [F.pow(F.sin(F.rand(seed + a) * (math.pi / 2)), 2) for a in axes]
    else:
        for a in axes:
            rows = rows.withColumn(f"g{a}", F.randn(seed + a))
        norm = F.sqrt(sum((F.col(f"g{a}") * F.col(f"g{a}") for a in axes), F.lit(0.0)))
        rows = rows.withColumn("r", F.rand(seed + dims) * (SHELL_OUTER - SHELL_INNER) + SHELL_INNER).withColumn("norm", norm)
        values = [clip(F.col(f"g{a}") / F.greatest("norm", F.lit(1e-12)) * F.col("r") + 0.5) for a in axes]
    return rows.select("vec_id", *(v.cast("float").alias(f"m{a}") for a, v in enumerate(values)))


def random_boxes(lo: list[float], hi: list[float], ratio: float, n: int, seed: int = 42, jitter: bool = True, root: int | None = None) -> list[tuple[list[float], list[float]]]:
    """n boxes inside [lo, hi]: edges of range * ratio**(1/d), times 0.8 to 1.2 (jitter). root: another root than d."""
    rng, d = random.Random(seed), len(lo)
    out = []
    for _ in range(n):
        edges = [min(b - a, (b - a) * ratio ** (1 / (root or d)) * (rng.uniform(0.8, 1.2) if jitter else 1)) for a, b in zip(lo, hi)]
        centers = [rng.uniform(a + e / 2, b - e / 2) for a, b, e in zip(lo, hi, edges)]
        out.append(([c - e / 2 for c, e in zip(centers, edges)], [c + e / 2 for c, e in zip(centers, edges)]))
    return out


def random_balls(lo: list[float], hi: list[float], ratio: float, n: int, seed: int = 42) -> list[tuple[list[float], float]]:
    """n balls with centers in the inner four fifths and radius largest range * ratio**(1/d) / 2."""
    rng, d = random.Random(seed), len(lo)
    radius = max(b - a for a, b in zip(lo, hi)) * ratio ** (1 / d) / 2
    return [([rng.uniform(a + 0.1 * (b - a), b - 0.1 * (b - a)) for a, b in zip(lo, hi)], radius) for _ in range(n)]


def random_shells(lo: list[float], hi: list[float], ratio: float, inner: float, n: int, seed: int = 42) -> list[tuple[list[float], list[float], list[float], float]]:
    """n boxes, each with a ball of ratio * inner about its center to leave out."""
    radius = max(b - a for a, b in zip(lo, hi)) * (ratio * inner) ** (1 / len(lo)) / 2
    boxes = random_boxes(lo, hi, ratio, n, seed, jitter=False, root=2)
    return [(a, b, [(x + y) / 2 for x, y in zip(a, b)], radius) for a, b in boxes]


def random_polygons(lo: list[float], hi: list[float], ratio: float, sides: int, n: int, seed: int = 42) -> list[list[tuple[float, float]]]:
    """n polygons about random centers in the inner three fifths, kept inside the bounds: vertices at even angles, each off by up to a
    quarter of their distance, at 0.5 to 1.5 times the radius at which twice the area of a regular polygon
    is that share of the bounds'."""
    if sides < 3:
        raise ValueError("a polygon has three sides or more")
    rng = random.Random(seed)
    width, height = hi[0] - lo[0], hi[1] - lo[1]
    radius = math.sqrt(ratio * width * height / (sides * math.sin(2 * math.pi / sides)))
    out = []
    for _ in range(n):
        cx, cy = (rng.uniform(a + 0.2 * (b - a), b - 0.2 * (b - a)) for a, b in zip(lo[:2], hi[:2]))
        points = []
        for i in range(sides):
            angle = 2 * math.pi * (i + rng.uniform(-0.25, 0.25)) / sides
            r = radius * rng.uniform(0.5, 1.5)
            points.append((min(max(cx + r * math.cos(angle), lo[0]), hi[0]), min(max(cy + r * math.sin(angle), lo[1]), hi[1])))
        out.append(points)
    return out


def workload_files(spark: SparkSession, folder: str, n: int, dims: tuple[int, ...] = (2, 3, 4)) -> list[str]:
    """Every distribution in every number of dimensions, as attribute files; their paths."""
    from ..sources.records import write_records

    paths = []
    for kind in DISTRIBUTIONS:
        for d in dims:
            paths.append(f"{folder}/{kind}_{d}d.bin")
            write_records(attribute_points(spark, kind, n, d), paths[-1], "attributes", "vec_id", [f"m{a}" for a in range(d)], d)
    return paths
