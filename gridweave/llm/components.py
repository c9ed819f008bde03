"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shared import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every end of the edges (a, b), as a written table: root is one vertex of v's component.

    Each round maps every vertex to the least of its neighbourhood and contracts the edges, which
    leaves a constant share of them for ids that are hashes. The mapping is only composed from
    tables, so nothing grows on the driver. No edges: no rows.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        lowest = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("root")))
        if labels is None:
            labels = lowest
        else:
            step = lowest.select(F.col("v").alias("root"), F.col("root").alias("next"))
            before = labels
            labels = written(before.join(step, "root", "left").select("v", F.coalesce("next", "root").alias("root")))
            dropped(before)
        to = lambda side: lowest.select(F.col("v").alias(side), F.col("root").alias(f"new_{side}"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").filter("new_a <> new_b")
        moved = written(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct())
        dropped(edges)
        if lowest is not labels:
            dropped(lowest)
        edges = moved
    if labels is None:
        labels = written(edges.select(F.col("a").alias("v"), F.col("b").alias("root")))
    dropped(edges)
    return labels
