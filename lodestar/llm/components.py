"""Connected components of a link table, by alternating large-star and small-star rounds.

Everything stays in DataFrames: each round is two aggregations with partial sums and two joins, so a
hub with a third of all links is split by the skew-join rule and never gathered.  Kiveris et al.,
"Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node id reachable) for every node that has a link to another.

    Null ends, self links and repeated links change nothing; an empty table gives an empty result.
    """
    down = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    current = materialize(down.distinct(), "links")
    while True:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large, "large-star")
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before, current = current, materialize(small.union(root.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        discard(before, large)
        forked = current.groupBy("hi").count().where("count > 1").select("hi")
        deeper = current.select(F.col("lo").alias("hi")).join(current.select("hi"), "hi", "left_semi")
        if forked.union(deeper).isEmpty():
            break
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
