"""Connected components of a table of links, by repeated contraction.

In each round every node that still has links points to that node among its
neighbours and itself which has the least hash (another hash each round), and
the links are rewritten to what their ends point to.  A fixed share of the
nodes is expected to go in a round, whatever the shape of the graph, so the
number of rounds grows with the logarithm of the largest component.  Minima
are combined before the shuffle, so a node with very many links is no burden
to one task, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; a component's name is one of its nodes.

    Nodes without a link to another node are left out.
    """
    both = links.where("a != b").select("a", "b").union(links.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both.distinct())
    names, rounds = None, 0
    while not edges.isEmpty():
        rounds += 1
        order = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        least = edges.groupBy("a").agg(F.min(order("b")).alias("m"))
        to = materialise(least.select("a", F.when(F.col("m.h") < F.xxhash64("a", F.lit(rounds)), F.col("m.n")).otherwise(F.col("a")).alias("to")))
        if names is None:
            names = to.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            step = to.select(F.col("a").alias("component"), "to")
            names = names.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        left = edges.join(to, "a").select(F.col("to").alias("x"), "b")
        right = to.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = materialise(left.join(right, "b").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return materialise(names)
