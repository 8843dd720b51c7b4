"""Distributed union-find: connected components of an edge table.

Alternating large-star and small-star steps over plain joins and grouped
minima, until every component is a star.  No node's neighbours are ever
gathered in one row, nothing goes to the driver but one answer a round, and
each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether each node of distinct edges (u, v), v < u, has one smaller neighbour, which has none."""
    several = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    inner = e.join(e.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").select("u")
    return several.unionByName(inner).isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node with an edge to another node.

    edges: columns u, v, of one integral type without nulls; loops, repeats
    and both directions are allowed.  component is the smallest node reached.
    An empty table gives an empty table.
    """
    e = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(e):
        old = e
        e = scratch.keep(_small_star(_large_star(e)))
        scratch.drop(old)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
