"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label: the smallest node reachable from each node that stands in `edges` (u, v).

    Each round gives a node the least label among its own and its neighbours', then the label of
    that label; it ends when no label changes. Rounds are written to the shared folder, labels never
    reach the driver, only whether there was a change.
    """
    both = written(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).where("u <> v").distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label"))
    labels = written(labels, "labels")
    for _ in range(most_rounds):
        heard = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("heard"))
        least = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("l"))
        jump = least.select(F.col("node").alias("l"), F.col("l").alias("ll"))
        new = written(least.join(jump, "l", "left").select("node", "old", F.coalesce("ll", "l").alias("label")), "labels")
        changed = new.where("label <> old").head(1)
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
