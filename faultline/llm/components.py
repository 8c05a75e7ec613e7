"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v) with u > v: every neighbour is tied to the least node that its centre knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = both.join(least, F.col("u") == F.col("c"))
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v (any order). Returns (node, component) for every node that isn't its component's least.

    Minima are combined before the shuffle and the joins are plain inner joins, so a node with many neighbours is
    split by adaptive execution. Each round is written out; the number of rounds grows with the logarithm of the
    longest path.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    last = None
    while True:
        ordered = save(_star(_star(ordered, large=True), large=False), "star")
        now = ordered.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return ordered.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = now
