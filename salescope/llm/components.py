"""Connected components of an edge table by alternating large and small stars.

Every half round joins each edge with the least neighbour of one of its ends
and keeps one edge to that neighbour, so a round never adds edges.  The least
neighbours are an aggregate with map-side combine, written as a table: the
join with it is a plain one, which Spark broadcasts when the table's size is
below its threshold and splits at a hot node otherwise.  Nothing but a row
count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, materialize


EDGES_PER_FILE = 200_000


def _canonical(edges: DataFrame) -> DataFrame:
    return (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter("a <> b").groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the component is
    the least node that can be reached.  Nodes without an edge are left out."""
    edges = materialize(_canonical(edges), "edges")
    mark = _mark(edges)
    while mark[0]:
        old = edges
        # no round has more edges than the one before: few edges need few files
        files = 1 + mark[0] // EDGES_PER_FILE
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", files)
        large = materialize(_canonical(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))), "edges", files)
        # small star: u and its smaller neighbours go to the least of them
        small_least = materialize(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least", files)
        joined = large.withColumnRenamed("a", "u").join(small_least, "u")
        edges = materialize(_canonical(
            joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                            F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")),
            "edges", files)
        now = _mark(edges)
        for t in (least, large, small_least, old):
            drop(t)
        if now == mark:
            break
        mark = now
    # now a star around each component's least node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct())
