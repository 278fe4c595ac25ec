"""Counts that the keeping of a library is decided by: what to promote, repair, discover, transfer or review.

All are aggregations with partial sums over ids; limits are parameters whose defaults are those of the policy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def promotable(supports: DataFrame, least: int = 3) -> DataFrame:
    """``concept, supporters`` of candidate concepts that ``least`` or more works support (``concept, work``)."""
    return supports.groupBy("concept").agg(F.count_distinct("work").alias("supporters")).where(F.col("supporters") >= least)


def parity(concepts: DataFrame, uses: DataFrame, listed: DataFrame, cards: DataFrame) -> DataFrame:
    """``problem, item``: what registry, cards and index do not agree on.

    ``orphan`` concepts (``slug, status, successor``) no card ``uses`` (``card, slug``); ``deprecated`` ones some card still uses, with what
    it should use; cards (``card``) that the index does not list (``listed``: ``card``), and listed ones that have no file.
    """
    used = uses.select("slug").distinct()
    orphans = concepts.where("status <> 'deprecated'").join(used, "slug", "left_anti").select(F.lit("orphan").alias("problem"), F.col("slug").alias("item"))
    old = uses.join(concepts.where("status = 'deprecated'"), "slug").select(F.lit("deprecated"), F.concat_ws(" ", "card", "slug", "successor")).distinct()
    unlisted = cards.select("card").distinct().join(listed, "card", "left_anti").select(F.lit("unlisted"), "card")
    missing = listed.select("card").distinct().join(cards, "card", "left_anti").select(F.lit("no file"), "card")
    return reduce(DataFrame.union, [orphans, old, unlisted, missing])


def discover_gate(works: DataFrame, papers: int = 15, crossing: int = 3) -> DataFrame:
    """``topic, papers, crossing, open``: whether a topic has works (``topic, work, crosses``) enough, and enough that cross domains."""
    each = works.groupBy("topic", "work").agg(F.max(F.col("crosses").cast("int")).alias("x"))
    out = each.groupBy("topic").agg(F.count(F.lit(1)).alias("papers"), F.sum("x").alias("crossing"))
    return out.withColumn("open", (F.col("papers") >= papers) & (F.col("crossing") >= crossing))


def transfer_candidates(bridges: DataFrame, stopword: Column, least: int = 2, most: int = 5) -> DataFrame:
    """``transfer, bridges``: the ``most`` transfers (``transfer, bridge``) with most bridges that are no stopwords, ``least`` or more of them."""
    kept = bridges.where(~F.coalesce(stopword, F.lit(False))).groupBy("transfer").agg(F.count_distinct("bridge").alias("bridges")).where(F.col("bridges") >= least)
    return kept.orderBy(F.desc("bridges"), "transfer").limit(most)


def rule_support(observations: DataFrame, least: int = 3) -> DataFrame:
    """``rule, support, n, stable``: how many of a style rule's observations (``rule, fits``) fit; stable with ``least`` and none against."""
    support, against = F.count(F.when(F.col("fits"), 1)), F.count(F.when(~F.col("fits"), 1))
    return observations.groupBy("rule").agg(support.alias("support"), F.count(F.lit(1)).alias("n"), ((support >= least) & (against == 0)).alias("stable"))


def cadence(works: DataFrame, every: int = 20, backlog: int = 20) -> DataFrame:
    """``topic, papers, rounds, backlog``: rounds of governance that a topic's works (``topic, waiting``) ask for, and whether too many wait."""
    n = F.count(F.lit(1))
    return works.groupBy("topic").agg(n.alias("papers"), F.floor(n / every).alias("rounds"), (F.count(F.when(F.col("waiting"), 1)) > backlog).alias("backlog"))


def timeline(works: DataFrame) -> DataFrame:
    """``concept, year, works``: works (``concept, year, work``) on a concept by year."""
    return works.groupBy("concept", "year").agg(F.count_distinct("work").alias("works"))


def status_radar(cards: DataFrame) -> DataFrame:
    """``kind, status, n, newest``: cards (``kind, status, year``) of each kind and status, and their last year; an empty status is ``(none)``."""
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("(none)"))
    return cards.groupBy("kind", status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max("year").alias("newest"))
