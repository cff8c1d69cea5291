"""Connected components of an edge table, without collecting it.

Rounds of large-star and small-star operations (Kiveris et al., "Connected Components in
MapReduce and Beyond") turn the edges into one star per component.  Each round is written
to the shared folder, so lineage stays short and a lost executor costs one round at most.
The minima combine on the map side; in the joins with them a hub's rows are one key, whose
partition the adaptive planner splits, as the other side has one row for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm import shared


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes that have an edge.

    ``edges`` has non-null long columns ``a`` and ``b``; loops are ignored.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = shared.scratch(links.sparkSession, "links")
    links = shared.stored(links, "links", at=path)
    for _ in range(rounds):
        # large star: larger neighbours of u link to u's smallest neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours link to the smallest of them
        large = large.filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, path = path, shared.scratch(links.sparkSession, "links")
        links = shared.stored(star.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links", at=path)
        shared.remove(links.sparkSession, last)
        # done when no node that links down is itself linked to, and none links twice
        ends = links.select(F.col("u").alias("x"), F.lit(1).alias("down")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("down")).distinct())
        if not ends.groupBy("x").agg(F.sum("down").alias("s"), F.count("*").alias("n")).filter("s > 0 AND n > 1").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
