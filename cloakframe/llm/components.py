"""Connected components of an edge table, by alternating large and small stars.

Each round is two grouped minima and two joins; edges stay distributed, each round's edges are written to
the shared folder, and only two numbers a round (a count and a checksum) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, join_unique, release, written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """``n`` is the number of edges: where twice as many rows may be broadcast, the least neighbours are."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(F.broadcast(least), "u") if 2 * n <= BROADCAST_ROWS else join_unique(both, least, "u", 2 * n)
    return met.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The edges come from ``_large_star``, so each node has few smaller neighbours and no key is hot."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs, in either order, repeats and self-pairs allowed -> (node, root), root the least node reachable.

    Nodes that occur in self-pairs alone are left out. No edges give an empty table.
    """
    mark = written()
    current = durable(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")), "edges")
    before = None
    while True:
        after = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if after == before or after["n"] == 0:
            break
        before = after
        current = durable(_small_star(_large_star(current, after["n"])), "edges")
        release(mark, current)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
