"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import keep


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One union step: neighbours of each node are linked to its least neighbour instead.

    ``large`` moves the neighbours above a node, otherwise those below it. The least
    neighbour is a partial aggregate and comes back by a join, so no task holds a node's
    neighbourhood.
    """
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its least reachable node) of all nodes of links (a, b).

    Alternates unions of higher and lower neighbours until nothing changes; every round
    is written to the shared folder. Nodes that are their component's least are left out.
    """
    links = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        sums = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if sums[0] == 0 or sums == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = sums
        links = keep(_stars(_stars(links, True), False))
