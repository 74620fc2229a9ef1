"""Predicates over attribute points, and what they allow to prune.

A filter gives a boolean Column (`column`) and, where its positive conjunctive part is bounded, a box
that holds every point it accepts (`bounds`, None: anywhere). Negation never prunes, disjunction prunes
by the union of both sides' boxes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import Ball, Box, Polygon, single


class Filter:
    def column(self, point: list[Column]) -> Column:
        raise NotImplementedError

    def bounds(self) -> Box | None:
        return None

    def __and__(self, other: Filter) -> Filter:
        return And(self, other)

    def __or__(self, other: Filter) -> Filter:
        return Or(self, other)

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class Everything(Filter):
    def column(self, point):
        return F.lit(True)


@dataclass(frozen=True)
class InBox(Filter):
    box: Box

    def column(self, point):
        return self.box.contains(point)

    def bounds(self):
        return self.box


@dataclass(frozen=True)
class InBall(Filter):
    ball: Ball

    def column(self, point):
        return self.ball.contains(point)

    def bounds(self):
        return self.ball.box()


@dataclass(frozen=True)
class InPolygon(Filter):
    polygon: Polygon

    def column(self, point):
        return self.polygon.contains(point)

    def bounds(self):
        return self.polygon.box()


@dataclass(frozen=True)
class Predicate(Filter):
    """Any boolean Column, or a function of the point that makes one: the user's own filter."""

    test: object

    def column(self, point):
        return self.test(point) if callable(self.test) and not isinstance(self.test, Column) else self.test


@dataclass(frozen=True)
class And(Filter):
    a: Filter
    b: Filter

    def column(self, point):
        return self.a.column(point) & self.b.column(point)

    def bounds(self):
        a, b = self.a.bounds(), self.b.bounds()
        if a is None or b is None:
            return a or b
        n = min(len(a.lo), len(b.lo))
        longer = a if len(a.lo) > n else b
        lo = [F.greatest(single(x), single(y)) for x, y in zip(a.lo, b.lo)] + list(longer.lo[n:])
        hi = [F.least(single(x), single(y)) for x, y in zip(a.hi, b.hi)] + list(longer.hi[n:])
        return Box(lo, hi)


@dataclass(frozen=True)
class Or(Filter):
    a: Filter
    b: Filter

    def column(self, point):
        return self.a.column(point) | self.b.column(point)

    def bounds(self):
        a, b = self.a.bounds(), self.b.bounds()
        if a is None or b is None:
            return None
        n = min(len(a.lo), len(b.lo))
        return Box([F.least(single(x), single(y)) for x, y in zip(a.lo[:n], b.lo[:n])], [F.greatest(single(x), single(y)) for x, y in zip(a.hi[:n], b.hi[:n])])


@dataclass(frozen=True)
class Not(Filter):
    a: Filter

    def column(self, point):
        return ~self.a.column(point)


def composite(
    box: Box | None = None, ball: Ball | None = None, polygon: Polygon | None = None, not_box: bool = False, not_ball: bool = False, not_polygon: bool = False, any_of: bool = False
) -> Filter:
    """[not] box, [not] ball and [not] polygon, joined by AND (any_of: by OR); nothing given accepts all."""
    parts: list[Filter] = []
    for shape, kind, negate in ((box, InBox, not_box), (ball, InBall, not_ball), (polygon, InPolygon, not_polygon)):
        if shape is not None:
            parts.append(Not(kind(shape)) if negate else kind(shape))
    if not parts:
        return Everything()
    out = parts[0]
    for p in parts[1:]:
        out = Or(out, p) if any_of else And(out, p)
    return out


def label_filter(x: int, label: str = "vec_id", attribute: str = "m0") -> tuple[Filter, Filter]:
    """The two forms of the label test: label > x, and first attribute >= x."""
    return Predicate(F.col(label) > x), Predicate(F.col(attribute) >= x)
