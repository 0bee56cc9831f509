"""Connected components of an edge list by alternating large and small stars.

Each step joins the edges with one minimum per node. The minima are read back
from files, so a hub's edges are a broadcast join or split among tasks. Every
step is written to the shared folder: nothing is recomputed after a loss and
nothing but one answer a step reaches the driver: whether stars are all that is
left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import settle


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is no larger end."""
    ends = edges.groupBy("a").agg(F.count(F.lit(1)).alias("up")).select(F.col("a").alias("u"), "up", F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by = ends.groupBy("u").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    return by.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()


def _least(directed: DataFrame) -> DataFrame:
    least = directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return settle(least, "least")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges(a, b)``: the smallest id that
    can be reached. Edges may repeat, point either way and be loops."""
    # a node's edges stand as (larger, smaller)
    tidy = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    loops = edges.where("a = b").select("a").distinct()
    edges = settle(tidy(edges.where("a <> b")), "edges")
    nodes = edges.select("a").union(edges.select("b")).union(loops).distinct()
    while not _stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        larger = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = settle(tidy(larger.where("a <> b")), "large-star")
        down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = _least(down)
        smaller = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        smaller = smaller.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = settle(tidy(smaller.where("a <> b")), "small-star")
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.withColumnRenamed("a", "id").join(roots, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
