"""Connected components of a graph of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the least node reachable.

    Each round hooks every label to its least neighbour and contracts the links, so only links
    between labels that still differ are left; a star takes one round, a chain a few more.
    """
    links = stored(links.select("a", "b").where(F.col("a") != F.col("b")), "links")
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node"))
    rest = links
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("x"), F.col("b").alias("y")).union(rest.select("b", "a"))
        hooks = stored(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to")), "links")
        labels = stored(labels.join(hooks, F.col("label") == F.col("x"), "left")
                        .select("node", F.coalesce("to", "label").alias("label")), "links")
        left = hooks.select(F.col("x").alias("a"), F.col("to").alias("a_to"))
        right = hooks.select(F.col("x").alias("b"), F.col("to").alias("b_to"))
        rest = stored(rest.join(left, "a").join(right, "b").where(F.col("a_to") != F.col("b_to"))
                      .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
    return labels
