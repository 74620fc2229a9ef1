"""A hierarchy of uniform grids over attribute points: layer L cuts each axis into 2**(L+1) cubes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Ball, Box, Polygon, both, single

EPSILON = 1e-6


def global_box(points: DataFrame, axes: list[str], widen: float = EPSILON) -> tuple[list[float], list[float]]:
    """Least and greatest value of each axis, widened on each side by that share of its range."""
    row = points.agg(*(f(a).cast("double").alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if row is None or any(v is None for v in row):
        raise ValueError("no attribute points")
    lo, hi = ([row[f"{n}_{a}"] for a in axes] for n in ("lo", "hi"))
    return [a - (b - a) * widen for a, b in zip(lo, hi)], [b + (b - a) * widen for a, b in zip(lo, hi)]


def adaptive_layers(n: int, d: int, most: int, least_points: int) -> int:
    """Layer 0 always; layer L while its cubes hold `least_points` points on average, at most `most`."""
    layers = 1
    while layers < most and n / (2 ** (layers + 1)) ** d >= least_points:
        layers += 1
    return layers


@dataclass(frozen=True)
class Grid:
    lo: tuple[float, ...]
    hi: tuple[float, ...]
    layers: int

    @property
    def dims(self) -> int:
        return len(self.lo)

    def cubes(self, layer: int) -> int:
        return 2 ** (layer + 1)

    def widths(self, layer: int) -> list[float]:
        return [(b - a) / self.cubes(layer) for a, b in zip(self.lo, self.hi)]

    def diagonal(self, layer: int) -> float:
        return math.sqrt(sum(w * w for w in self.widths(layer)))

    def index(self, value: Column, axis: int, layer: int) -> Column:
        """A value's cube along an axis, clamped into the grid; axes without extent have one cube."""
        w, c = self.widths(layer)[axis], self.cubes(layer)
        if w <= 0:
            return F.lit(0).cast("long")
        return F.least(F.greatest(F.floor((value.cast("double") - F.lit(self.lo[axis])) / F.lit(w)), F.lit(0)), F.lit(c - 1)).cast("long")

    def encode(self, index: list[Column], layer: int) -> Column:
        c = self.cubes(layer)
        return reduce(lambda a, b: a + b, [i * F.lit(c**d) for d, i in enumerate(index)]).cast("long")

    def decode(self, cube: Column, layer: int) -> list[Column]:
        c = self.cubes(layer)
        return [F.pmod(F.floor(cube / F.lit(c**d)).cast("long"), F.lit(c)) for d in range(self.dims)]

    def cube_of(self, point: list[Column], layer: int) -> Column:
        return self.encode([self.index(p, d, layer) for d, p in enumerate(point[: self.dims])], layer)

    def cube_box(self, cube: Column, layer: int) -> tuple[list[Column], list[Column]]:
        w = self.widths(layer)
        lo = [F.lit(self.lo[d]) + i * F.lit(w[d]) for d, i in enumerate(self.decode(cube, layer))]
        return lo, [x + F.lit(w[d]) for d, x in enumerate(lo)]

    def assign(self, points: DataFrame, axes: list[str]) -> DataFrame:
        """`points` with a column cube_L for every layer, in one pass."""
        return points.withColumns({f"cube_{k}": self.cube_of([F.col(a) for a in axes], k) for k in range(self.layers)})

    def adjacency(self, df: DataFrame, cube: str, layer: int) -> DataFrame:
        """Each cube with its face neighbours, axis by axis, lower one first; none beyond the edge."""
        c = self.cubes(layer)
        index = self.decode(F.col(cube), layer)
        options = []
        for d in range(self.dims):
            for step in (-1, 1):
                near = index[d] + F.lit(step)
                options.append(F.when(near.between(0, c - 1), F.struct(F.lit(len(options)).alias("ord"), (F.col(cube) + F.lit(step * c**d)).alias("neighbor_id"))))
        return df.withColumn("n_", F.explode(F.array_compact(F.array(*options)))).select("*", "n_.ord", "n_.neighbor_id").drop("n_")

    # Which layer suits a filter: the first (coarsest) one whose cubes are small against it.
    def layer_for_box(self, box: Box) -> Column:
        out = F.lit(self.layers - 1)
        for k in reversed(range(self.layers)):
            wide = reduce(lambda a, b: a | b, [e > F.lit(w) for e, w in zip(box.edges(), self.widths(k))])
            out = F.when(wide, k).otherwise(out)
        return out

    def layer_for_ball(self, ball: Ball) -> Column:
        out = F.lit(self.layers - 1)
        for k in reversed(range(self.layers)):
            out = F.when(single(ball.radius) * 2 > F.lit(self.diagonal(k)), k).otherwise(out)
        return out

    def layer_for_polygon(self, polygon: Polygon) -> Column:
        out = F.lit(self.layers - 1)
        for k in reversed(range(self.layers)):
            wide = reduce(lambda a, b: a | b, [e * 2 > F.lit(self.diagonal(k)) for e in polygon.box().edges()])
            out = F.when(wide, k).otherwise(out)
        return out

    # The cubes a filter can touch (closed: a shared face counts), in closed form.
    def spans(self, box: Box, layer: int) -> list[tuple[Column, Column]]:
        """First and last cube of the box along each axis of the grid."""
        c, w = self.cubes(layer), self.widths(layer)
        out = []
        for d in range(self.dims):
            if d < len(box.lo) and w[d] > 0:
                first = F.ceil((single(box.lo[d]) - F.lit(self.lo[d])) / F.lit(w[d])) - 1
                last = F.floor((single(box.hi[d]) - F.lit(self.lo[d])) / F.lit(w[d]))
                out.append(tuple(F.least(F.greatest(x, F.lit(0)), F.lit(c - 1)).cast("long") for x in (first, last)))
            else:
                out.append((F.lit(0).cast("long"), F.lit(c - 1 if w[d] > 0 else 0).cast("long")))
        return out

    def cubes_in_box(self, box: Box, layer: int) -> Column:
        """How many cubes the box can touch."""
        return reduce(lambda x, y: x * y, [(last - first + 1).cast("double") for first, last in self.spans(box, layer)])

    def cubes_of_box(self, df: DataFrame, box: Box, layer: int, name: str = "cube_id") -> DataFrame:
        n = min(len(box.lo), self.dims)
        out = df.where(both([(single(box.hi[d]) >= F.lit(self.lo[d])) & (single(box.lo[d]) <= F.lit(self.hi[d])) for d in range(n)]))
        for d, (first, last) in enumerate(self.spans(box, layer)):
            out = out.withColumn(f"i{d}_", F.explode(F.sequence(first, last)))
        out = out.withColumn(name, self.encode([F.col(f"i{d}_") for d in range(self.dims)], layer))
        return out.drop(*(f"i{d}_" for d in range(self.dims)))

    def cubes_of_ball(self, df: DataFrame, ball: Ball, layer: int, name: str = "cube_id") -> DataFrame:
        """Rows are dealt to cubes by division, cubes' faces come from products: a cube is let in that is a
        rounding out of reach."""
        near = self.cubes_of_box(df, ball.box(), layer, name)
        lo, hi = self.cube_box(F.col(name), layer)
        slack = [F.lit(1e-12 * max(abs(a), abs(b), b - a)) for a, b in zip(self.lo, self.hi)]
        return near.where(ball.meets([x - e for x, e in zip(lo, slack)], [x + e for x, e in zip(hi, slack)]))

    def cover_of_polygon(self, df: DataFrame, polygon: Polygon, layer: int, name: str = "cube_id") -> DataFrame:
        """The cubes that the polygon reaches, and `inside`: the cube lies in it whole, so that its rows pass
        untested. A cube that no edge meets is inside or outside as its center is; axes beyond the second do not
        matter. A cube is let in (not inside) that is a rounding out of reach."""
        # the vertices are made once a row, before it is listed in cubes
        corners = {f"v{i}{d}_": single(v) for i, vertex in enumerate(polygon.vertices) for d, v in enumerate(vertex)}
        near = self.cubes_of_box(df.withColumns(corners), polygon.box(), layer, name)
        polygon = Polygon([(F.col(f"v{i}0_"), F.col(f"v{i}1_")) for i in range(len(polygon.vertices))])
        lo, hi = self.cube_box(F.col(name), layer)
        border = polygon.touches(_wider(lo, self.lo, self.hi, -1), _wider(hi, self.lo, self.hi, 1))
        center = polygon.contains([(a + b) / 2 for a, b in zip(lo, hi)])
        return near.withColumns({"border_": border, "center_": center}).where("border_ or center_").withColumn("inside", ~F.col("border_")).drop("border_", "center_", *corners)

    def cubes_of_polygon(self, df: DataFrame, polygon: Polygon, layer: int, name: str = "cube_id") -> DataFrame:
        return self.cubes_of_box(df, polygon.box(), layer, name)


def _wider(values: list[Column], grid_lo, grid_hi, sign: int) -> list[Column]:
    return [x + F.lit(sign * 1e-12 * max(abs(a), abs(b), b - a)) for x, a, b in zip(values, grid_lo, grid_hi)]


def two_cubes(key: Column, first: int) -> Column:
    """Cube 0 for keys under `first`, else cube 1."""
    return F.when(key < first, 0).otherwise(1).cast("long")


def ring_cube(key: Column, n: int) -> Column:
    """Cubes dealt in turn; each meets the one before and the one behind, the ends do not meet."""
    return F.pmod(key, F.lit(n)).cast("long")


def ring_neighbours(df: DataFrame, cube: str, n: int) -> DataFrame:
    near = F.filter(F.array(F.col(cube) - 1, F.col(cube) + 1), lambda x: x.between(0, n - 1))
    return df.withColumn("neighbor_id", F.explode(near))
