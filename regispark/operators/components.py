"""Connected components of an edge table, by label propagation with pointer jumping.

Each round a node takes the smallest label among its own and its neighbours', then jumps to its label's label, so
the number of rounds grows with the logarithm of the longest path. Every round is a pair of equi-joins; labels
and edges stay distributed and are checkpointed in the shared folder, and only a row count reaches the driver.
Edges inside a finished component leave the loop.

Defined results: null ends are ignored, loops make a component of one, repeated edges count once, an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regispark.session import cut_lineage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) with the smallest node of the component as its name."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = cut_lineage(e.union(e.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")))
    while True:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, "a").select("a", "l", F.least("l", "m").alias("m"))
        # Jump: a label that is itself a node is replaced by that node's label.
        over = labels.select(F.col("a").alias("m"), F.col("l").alias("n"))
        moved = cut_lineage(step.join(over, "m", "left").select("a", "l", F.least("m", F.coalesce("n", "m")).alias("x")))
        if moved.where("x <> l").limit(1).count() == 0:
            return moved.select(F.col("a").alias("node"), F.col("x").alias("component"))
        labels = moved.select("a", F.col("x").alias("l"))
