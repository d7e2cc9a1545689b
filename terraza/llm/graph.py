"""Connected components of an edge table, by hooking to the smallest neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge (a, b); root is the same for the nodes of a component.

    Each round sends every node to its smallest smaller neighbour, takes one jump, and puts the ends of the edges in place of
    the nodes; edges within a component vanish. Every round's tables are written to the shared folder, so none is recomputed.
    """
    left = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not left.isEmpty():
        up = left.groupBy("a").agg(F.min("b").alias("to"))
        jump = up.select(F.col("a").alias("to"), F.col("to").alias("far"))
        up = written(up.join(jump, "to", "left").select("a", F.coalesce("far", "to").alias("to")), "parents")
        step = up.select(F.col("a").alias("mid"), F.col("to").alias("root"))
        labels = labels.withColumnRenamed("root", "mid").join(step, "mid", "left").select("node", F.coalesce("root", "mid").alias("root"))
        labels = written(labels, "labels")
        for end in ("a", "b"):
            left = left.join(step.withColumnRenamed("mid", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        left = written(left.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return labels
