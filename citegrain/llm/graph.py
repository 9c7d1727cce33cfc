"""Distributed union-find over edge tables, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.operators.durable import durable, freed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The root of every node that has an edge: (node, root), root being the smallest node it reaches.

    Large-star and small-star steps alternate (Kiveris et al. 2014): each node hands its neighbours to the
    smallest of them, until every node hangs on its root.  A round is two aggregates with map-side combine
    and two joins, whose hot keys Spark's skew join can split; rounds are checkpointed, and what the round
    before left on disk and in the driver goes at once.  Node columns may be of any ordered type.  Nulls and self-loops are ignored, repeated edges count once, and an empty
    table gives an empty result.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = edges.where(F.col(a) != F.col(b)).select(u, v).distinct()
    links = freed(durable(links))
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # every link now points from the larger node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        ).select("e.u", "e.v").where("u != v").distinct()
        links = freed(durable(small))
        mark = F.xxhash64("u", "v")
        total = links.agg(F.count(F.lit(1)), F.sum(mark.cast("decimal(38,0)"))).first()
        after = (total[0], total[1])
        if after == before:
            break
        before = after
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
