"""One table without an index: filter and sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box
from .filters import Filter, InBox
from .knn import exact_knn, post_filter, valid


class FlatIndex:
    def __init__(self, axes: list[str], dim: int | None = None):
        self.axes, self.dim, self.table = axes, dim, None

    def build(self, table: DataFrame) -> FlatIndex:
        self.table = valid(table, self.axes, self.dim)
        return self

    def save(self, path: str) -> None:
        self._built().write.mode("overwrite").parquet(path)

    def load(self, spark, path: str) -> FlatIndex:
        return self.build(spark.read.parquet(path))

    def _built(self) -> DataFrame:
        if self.table is None:
            raise RuntimeError("the index is not built")
        return self.table

    def search(self, queries: DataFrame, k: int, keep: Filter | None = None, oversample: int | None = None) -> DataFrame:
        point = [F.col(a) for a in self.axes]
        if oversample:
            return post_filter(self._built(), queries, k, point, keep, oversample, self.dim)
        return exact_knn(self._built(), queries, k, point, keep, self.dim)

    def search_with_bounds(self, queries: DataFrame, k: int, lo: list, hi: list) -> DataFrame:
        return self.search(queries, k, InBox(Box(lo, hi)))
