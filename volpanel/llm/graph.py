"""Connected components over an edge table, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to its component's smallest node and no other."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component), stored: the smallest node that edges (a, b) reach, for every node with an edge to another.

    Alternates two steps until the edges are stars around the smallest nodes: every node's larger neighbours are tied to its
    smallest neighbour, then its smaller ones. Neither makes more edges than it gets, and the rounds grow with the logarithm
    of the nodes. The smallest neighbours come from partially aggregated sums and are written before they are joined, so that
    a node with very many edges stands in one small row on one side and can be split on the other.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    while not _stars(edges):
        both = edges.union(edges.select("b", "a"))
        lowest = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "lowest")
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "edges")
        discard(edges, lowest)
        if _stars(large):
            edges = large
            break
        lowest = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(lowest, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "edges")
        discard(large, lowest)
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = stored(found.union(edges.select(F.col("b"), F.col("b")).distinct()), "components")
    discard(edges)
    return whole
