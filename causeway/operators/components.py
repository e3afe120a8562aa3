"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.scratch import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs each node's larger neighbours on the smallest of itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs each node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: bigints ``a``, ``b``. Returns ``node``, ``component`` (the smallest node reachable) of every node with an edge.

    Each round is written to the shared folder, which cuts lineage; the rounds end when the edges,
    all of them from a node to its component by then, stay the same. No node or edge reaches the driver.
    """
    now, before = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges"), None
    while True:
        after = materialize(_small_star(_large_star(now)), "edges")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(now)
        now = after
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
