"""Graphs as edge tables: components, and what is left of a graph when its leaves are peeled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraza.sources.scratch import apart, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge, whichever way it points: the smallest node that is connected with it.

    Every round takes each node to the smallest root among its neighbours, then to that one's root, and is written; rounds grow with the
    logarithm of a component's width, about. A node with very many edges is one row on one side of each join and is summed up
    before it is shuffled. Edges with a null end are left out; a loop alone makes a component of one.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        root = labels.select(F.col("node").alias("b"), "root")
        near = both.join(apart(root), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        own = labels.join(apart(near), "node").select("node", "root", F.least("root", "near").alias("to"))
        # The root itself goes along, so that all that it leads follows, and every node takes a jump.
        pulled = own.where("to < root").groupBy(F.col("root").alias("node")).agg(F.min("to").alias("pulled"))
        own = written(own.join(apart(pulled), "node", "left").select("node", "root", F.least("to", "pulled").alias("to")), "labels")
        jump = own.select(F.col("node").alias("to"), F.col("to").alias("far"))
        after = written(own.join(apart(jump), "to", "left").select("node", "root", F.least("to", F.coalesce("far", "to")).alias("to")), "labels")
        moved = not after.where("root <> to").isEmpty()
        labels = after.select("node", F.col("to").alias("root"))
        if not moved:
            return labels.withColumnRenamed("root", "component")


def peeled(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The edges (a, b) that lie on a cycle or between cycles: those of nodes that lead nowhere, or that nothing leads to, go, again and again.

    There is no limit to the rounds; there are as many as the longest chain that ends, and each is written. Loops are cycles. Edges with
    a null end are left out.
    """
    left = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct(), "edges")
    n = left.count()
    while n:
        ends = left.select("a").distinct().join(apart(left.select(F.col("b").alias("a")).distinct()), "a", "left_semi")  # that edges leave and reach
        left = written(left.join(apart(ends), "a", "left_semi").join(apart(ends.withColumnRenamed("a", "b")), "b", "left_semi").select("a", "b"), "edges")
        n, before = left.count(), n
        if n == before:
            break
    return left


def cyclic(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component, nodes) of the nodes that peeling leaves: each component holds a cycle; nodes is how many it has."""
    left = written(components(peeled(edges, a, b)), "cycles")
    sizes = left.groupBy("component").agg(F.count("*").alias("nodes"))
    return left.join(apart(sizes), "component").select("node", "component", "nodes")
