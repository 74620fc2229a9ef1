"""Boxes, balls and polygons over low-dimensional attribute points, as values and as Columns.

Bounds are held in single precision, as the points are, and compared in double.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | Column


def single(x: Number) -> Column:
    """A bound in single precision, widened."""
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float").cast("double")


def both(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class Box:
    lo: list[Number]
    hi: list[Number]

    def __post_init__(self):
        if len(self.lo) != len(self.hi):
            raise ValueError("lower and upper bounds differ in length")

    def contains(self, point: list[Column]) -> Column:
        """Closed on both ends in every dimension of the box."""
        return both([single(p).between(single(a), single(b)) for p, a, b in zip(point, self.lo, self.hi)])

    def overlaps(self, other: Box) -> Column:
        """Closed: boxes that touch overlap."""
        return both([(single(b) >= single(c)) & (single(a) <= single(d)) for a, b, c, d in zip(self.lo, self.hi, other.lo, other.hi)])

    def inside(self, other: Box) -> Column:
        return both([(single(a) >= single(c)) & (single(b) <= single(d)) for a, b, c, d in zip(self.lo, self.hi, other.lo, other.hi)])

    def volume(self) -> Column:
        return reduce(lambda x, y: x * y, [single(b) - single(a) for a, b in zip(self.lo, self.hi)], F.lit(1.0))

    def center(self) -> list[Column]:
        return [(single(a) + single(b)) / 2 for a, b in zip(self.lo, self.hi)]

    def edges(self) -> list[Column]:
        return [single(b) - single(a) for a, b in zip(self.lo, self.hi)]


@dataclass(frozen=True)
class Ball:
    center: list[Number]
    radius: Number

    def contains(self, point: list[Column]) -> Column:
        """Closed: points at the radius are inside. The bounding box is named too, for pushdown."""
        gaps = [single(p) - single(c) for p, c in zip(point, self.center)]
        r = single(self.radius)
        near = both([single(p).between(single(c) - r - F.lit(1e-9), single(c) + r + F.lit(1e-9)) for p, c in zip(point, self.center)])
        return near & (reduce(lambda a, b: a + b, [g * g for g in gaps]) <= r * r)

    def box(self) -> Box:
        r = single(self.radius)
        return Box([single(c) - r for c in self.center], [single(c) + r for c in self.center])

    def meets(self, lo: list[Column], hi: list[Column]) -> Column:
        """Whether the ball reaches the box: its center, clamped into the box, is within the radius."""
        gaps = [single(c) - F.least(F.greatest(single(c), a), b) for c, a, b in zip(self.center, lo, hi)]
        r = single(self.radius)
        return reduce(lambda a, b: a + b, [g * g for g in gaps]) <= r * r


@dataclass(frozen=True)
class Polygon:
    """Constrains the first two attributes; the even-odd rule with half-open edges."""

    vertices: list[tuple[Number, Number]]

    def _edges(self):
        v = self.vertices
        return list(zip(v, v[1:] + v[:1]))

    def contains(self, point: list[Column]) -> Column:
        x, y = (single(p) for p in point[:2])
        crossings = F.lit(0)
        for (ax, ay), (bx, by) in self._edges():
            ax, ay, bx, by = single(ax), single(ay), single(bx), single(by)
            crosses = (ay > y) != (by > y)
            at = (bx - ax) * (y - ay) / F.when(crosses, by - ay) + ax
            crossings = crossings + F.when(crosses & (x < at), 1).otherwise(0)
        return crossings % 2 == 1

    def box(self) -> Box:
        xs, ys = ([single(v[k]) for v in self.vertices] for k in (0, 1))
        if not xs:
            return Box([0.0, 0.0], [0.0, 0.0])
        if len(xs) == 1:
            return Box([xs[0], ys[0]], [xs[0], ys[0]])
        return Box([F.least(*xs), F.least(*ys)], [F.greatest(*xs), F.greatest(*ys)])

    def touches(self, lo: list[Column], hi: list[Column]) -> Column:
        """Whether an edge meets the closed box in the first two attributes: what of the edge lies between the
        box's sides, axis by axis, is not empty."""
        out = F.lit(False)
        for (ax, ay), (bx, by) in self._edges():
            first, last, beside = F.lit(0.0), F.lit(1.0), F.lit(True)
            for a, b, low, high in zip((ax, ay), (bx, by), lo, hi):
                a, b = single(a), single(b)
                step = F.when(a != b, b - a)  # an edge along the axis' normal is between the sides whole or not at all
                one, two = (low - a) / step, (high - a) / step
                beside = beside & ((a != b) | a.between(low, high))
                first = F.greatest(first, F.least(one, two))
                last = F.least(last, F.greatest(one, two))
            out = out | beside & (first <= last)
        return out

    def area(self) -> Column:
        """Shoelace; fewer than three vertices enclose nothing."""
        if len(self.vertices) < 3:
            return F.lit(0.0)
        terms = [single(ax) * single(by) - single(bx) * single(ay) for (ax, ay), (bx, by) in self._edges()]
        return F.abs(reduce(lambda a, b: a + b, terms)) / 2
