"""Connected components of an edge list by hooking onto the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import stored


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(v, root): for each vertex of edges (a long, b long), the smallest vertex that it is linked with.

    Labels start at the smallest neighbour. In each round a label's own label is taken first (pointer jumping), then the
    smallest of the neighbours' labels is hooked onto the old label, so long chains take a number of rounds that grows as
    the logarithm of their length. Vertices without an edge aren't returned. Each round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("v"), "root"))
    for _ in range(most):
        seen = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("root").alias("near"))
        met = labels.join(seen, labels["v"] == seen["a"], "left").select("v", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        # A smaller label found by one member goes to the member's old root, and from there to all that point at it.
        hooked = met.groupBy("root").agg(F.min("new").alias("over")).withColumnRenamed("root", "r")
        once = stored(met.join(hooked, met["root"] == hooked["r"]).select("v", F.col("root").alias("old"), F.least("new", "over").alias("root")))
        up = once.select(F.col("v").alias("w"), F.col("root").alias("above"))
        labels, before = stored(once.join(up, once["root"] == up["w"], "left").select("v", "old", F.least("root", F.coalesce("above", "root")).alias("root"))), labels
        if labels.filter("root <> old").isEmpty():
            return labels.select("v", "root")
        labels = labels.select("v", "root")
    raise RuntimeError(f"components did not settle in {most} rounds")
