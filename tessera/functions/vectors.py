"""Distances between vectors held as arrays of float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2sq(a: Column, b: Column, dim: int | None = None) -> Column:
    """Squared Euclidean distance in double precision.

    With the dimension known the sum is spelled out, which whole-stage code generation compiles;
    otherwise it is a fold over the arrays.
    """
    if dim is not None:
        total = None
        for i in range(dim):
            d = a[i].cast("double") - b[i].cast("double")
            total = d * d if total is None else total + d * d
        return total if total is not None else F.lit(0.0)
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v)


def sound(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector can be searched: not null, not empty, without null or NaN, of `dim` components if given."""
    length = F.size(vector) == dim if dim is not None else F.size(vector) > 0
    return vector.isNotNull() & length & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
