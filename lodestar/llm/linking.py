"""From buckets of possibly similar items to the pairs worth a comparison, without all pairs.

A bucket of K items first costs K - 1 comparisons, with its hub (the item that shares most buckets).
Only buckets whose items then still lie in several components need more; they are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def shared_buckets(members: DataFrame) -> DataFrame:
    """``bucket, item, n`` for buckets of ``n`` > 1 distinct items; written once."""
    members = members.select("bucket", "item").distinct()
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(members.join(sizes, "bucket"), "buckets")


def hub_pairs(buckets: DataFrame, worth: Callable[[Column, Column], Column]) -> DataFrame:
    """Distinct pairs ``a, b``: each item with the most widely shared item of each of its buckets, where ``worth`` holds.

    ``worth`` gets both rows as structs of all columns but ``bucket`` and ``n``; ``item`` is the first of them.
    """
    carried = [c for c in buckets.columns if c not in ("bucket", "n")]
    spread = buckets.groupBy("item").agg(F.sum("n").alias("spread"))
    ranked = buckets.join(spread, "item")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("spread", *carried)).alias("hub"))
    met = buckets.select("bucket", F.struct(*carried).alias("own")).join(hubs, "bucket").where("own.item <> hub.item")
    return met.where(worth(F.col("own"), F.col("hub"))).select(F.least("own.item", "hub.item").alias("a"), F.greatest("own.item", "hub.item").alias("b")).distinct()


def unsettled(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """The columns of ``buckets`` and ``component`` for buckets of over two items that span several components; written once.

    A bucket of two is settled: its only pair was compared in the round of hubs.
    """
    known = buckets.where("n > 2").join(components.withColumnRenamed("node", "item"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    split = known.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket")
    return materialize(known.join(split, "bucket").select(*buckets.columns, "component"), "unsettled")
