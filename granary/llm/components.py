"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, written

#: So many edges are joined as Spark sees fit; with more, no side of a join may be broadcast (each takes some 50 bytes in the driver).
FEW = 100_000


def _linked(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of one orderable type: (node, component) for every node of an edge, component its smallest node.

    Self-links, repeated and reversed edges change nothing; null ends are dropped; no edges give no rows.  A step keeps the
    graph's components and never makes more edges than it got.  The rounds grow as the logarithm of the longest chain.
    Each is written to the shared folder: the lineage stays short, and a lost executor costs no earlier round.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    met = shuffled if now.count() > FEW else lambda df: df
    while True:
        both = _linked(now)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: each larger neighbour of a goes to the least node about a
        large = both.filter("b > a").join(met(least), "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        large = written(large, "edges")
        # small star: a and its smaller neighbours go to the least of them
        down = large.select(F.col("b").alias("c"), F.col("a").alias("d"))
        least = down.groupBy("c").agg(F.min("d").alias("m"))
        small = down.join(met(least), "c").select(F.col("m").alias("a"), F.col("d").alias("b")).unionAll(
            least.select(F.col("m").alias("a"), F.col("c").alias("b"))
        ).filter("a < b").distinct()
        after = written(small, "edges")
        # stars: no node is both above and below another
        if after.select(F.col("a").alias("x")).join(after.select(F.col("b").alias("x")), "x", "left_semi").limit(1).count() == 0:
            if after.groupBy("b").count().filter("count > 1").limit(1).count() == 0:
                break
        now = after
    return after.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(
        after.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
