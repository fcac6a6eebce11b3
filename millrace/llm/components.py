"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One half step on (u, v) edges with u > v: neighbours move to the smallest node around ``u``.

    ``larger`` links every larger neighbour of a node to the smallest node around it; otherwise every
    smaller neighbour and the node itself. Both keep the components as they are.
    """
    around = edges
    if larger:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "star")
    joined = around.join(least, "u")
    if larger:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = joined.filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("low").alias("v")))
    return written(moved.filter(F.col("u") != F.col("v")).distinct(), "edges")


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``links`` (``a``, ``b``); the component is its smallest node.

    Alternating large and small stars; the number of rounds grows with the logarithm of the links.
    A self-link makes its node a component of one.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    alone = edges.filter(F.col("u") == F.col("v")).select(F.col("u").alias("node"))
    edges = edges.filter(F.col("u") != F.col("v"))
    while True:
        after = _star(_star(edges, larger=True), larger=False)
        # Done when every node hangs on a node that hangs on none.
        left = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        settled = left.limit(1).count() == 0
        edges = after
        if settled and after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() == 0:
            break
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    rest = alone.join(hung.unionByName(roots), "node", "left_anti").select("node", F.col("node").alias("component"))
    return written(hung.unionByName(roots).unionByName(rest), "components")
