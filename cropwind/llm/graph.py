"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropwind.sources.paths import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for edges ``a, b``: the smallest node that is reachable.

    Each round takes the smallest label among a node's neighbours and then the label's own label,
    so a chain halves in length. A round is a grouped minimum (combined before the shuffle, so a
    node with many neighbours costs one row a task) and equi-joins; its labels are a written table.
    No edges give no rows; loops and repeated edges do no harm.
    """
    edges = edges.select("a", "b")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component"))
    labels = written(labels, f"{name}-labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("label"))
        low = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        lower = labels.join(low, "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("now"))
        heads = labels.select(F.col("node").alias("now"), F.col("component").alias("head"))
        moved = lower.join(heads, "now", "left").select("node", "was", F.least("now", F.coalesce("head", "now")).alias("component"))
        moved = written(moved, f"{name}-labels")
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels
