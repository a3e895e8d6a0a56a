"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on the cluster only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.llm.common import cut


def _star(edges: DataFrame, rows: int) -> DataFrame:
    """One large-star step, then one small-star step, of ``rows`` distinct edges (u, v)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # what is joined back is stored first: both sides are then dealt out by the join, which may split the edges of a hub
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * rows)
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = cut(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")), rows)
    small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge in ``edges`` (u, v): root is the smallest node it can reach.

    Null ends and loops are no edges; repeated edges count once; no edges give no rows. Each round ends in a
    checkpoint, so that a lost executor costs one round at most. A count and a sum tell whether a round changed
    anything; nothing else goes to the driver.
    """
    edges = cut(edges.select("u", "v").where("u <> v").distinct(), few=True)  # else each use would find the links anew
    before = None
    rows = edges.count()
    while True:  # each round that changes anything brings some node nearer to its root
        edges = cut(_star(edges, rows), 2 * rows)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before, rows = now, now[0]
