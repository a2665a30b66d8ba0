"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.session import discard, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour; written."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")))
    # Both sides of the join are read from tables, so that Spark splits the rows of a hub with very many neighbours.
    made = settle(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct())
    discard(least)
    return made


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; written."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = settle(down.groupBy("a").agg(F.min("b").alias("least")))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    made = settle(linked.where("a <> b").distinct())
    discard(least)
    return made


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the least node it reaches.

    Each round halves the trees' depth at least; rounds end when a large and a
    small star leave the edges as they are. Loops and repeated edges are allowed.
    """
    links = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        large = _large_star(links)
        discard(links)
        links = _small_star(large)
        discard(large)
        new = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    # Every tree is a star round its least node now.
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
