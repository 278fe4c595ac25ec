"""Impact bands and reports that hold recorded figures against fresh ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, MEDIUM = 90, 50
YOUNG_YEARS = 3


def band(percentile: Column, quartile: Column, preprint: Column, reviewed: Column, age: Column) -> Column:
    """``band, channel``: the higher of the citation and venue bands, citations on a tie; null where neither is known.

    Percentiles are 0 to 100.  A preprint has no venue band; reviewed work of zero to under three years that is no preprint is at least medium.
    """
    cited = F.when(percentile >= HIGH, 3).when(percentile >= MEDIUM, 2).when(percentile.isNotNull(), 1)
    venue = F.when(~F.coalesce(preprint, F.lit(False)), F.when(quartile == "Q1", 3).when(quartile == "Q2", 2).when(quartile.isin("Q3", "Q4"), 1))
    best = F.greatest(cited, venue)
    young = F.coalesce((age >= 0) & (age < YOUNG_YEARS), F.lit(False))
    floor = F.coalesce(reviewed, F.lit(False)) & ~F.coalesce(preprint, F.lit(False)) & young & (F.coalesce(best, F.lit(0)) < 2)
    name = lambda c: F.when(c == 3, "high").when(c == 2, "medium").when(c == 1, "low")
    channel = F.when(floor, "floor").when(best.isNull(), F.lit(None)).when(F.coalesce(cited, F.lit(0)) >= F.coalesce(venue, F.lit(0)), "citations").otherwise("venue")
    return F.struct(F.when(floor, "medium").otherwise(name(best)).alias("band"), channel.alias("channel"))


def delta_report(recorded: DataFrame, fresh: DataFrame, key: str, value: str) -> DataFrame:
    """``key, old, new, delta`` where both know the item; nulls where a figure is no number."""
    both = recorded.select(key, F.col(value).alias("old")).join(fresh.select(key, F.col(value).alias("new")), key)
    return both.withColumn("delta", F.col("new") - F.col("old"))


def bands_by_category(snapshots: DataFrame, quartiles: DataFrame) -> DataFrame:
    """``work, category, band, channel, coarse``: one verdict for each category, never their highest.

    ``snapshots`` has ``work, venue, categories, percentile, preprint, reviewed, age``, ``quartiles`` ``venue, category,
    quartile`` with venues in lower case.  A work without categories is ``(uncategorized)``; unknown stays unknown.
    """
    named = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("(uncategorized)")))
    each = snapshots.withColumn("category", F.explode(named)).withColumn("place", F.lower("venue"))
    told = each.join(quartiles.select(F.col("venue").alias("place"), "category", "quartile"), ["place", "category"], "left")
    out = told.withColumn("x", band(F.col("percentile"), F.col("quartile"), F.col("preprint"), F.col("reviewed"), F.col("age")))
    name, channel = F.coalesce("x.band", F.lit("unknown")), F.coalesce("x.channel", F.lit("none"))
    return out.select("work", "category", name.alias("band"), channel.alias("channel"), (channel == "venue").alias("coarse"))


def refresh_buckets(works: DataFrame, records: DataFrame, live: bool = False) -> DataFrame:
    """``work, bucket, why``: what became of each work (``work, ref``) when its record was asked for.

    ``records`` has ``ref, error``: an answer, or why there was none.  ``updated`` has an answer; ``no_data`` has no identifier or,
    where nothing was fetched live, no answer; ``errors`` are asks that failed live.
    """
    told = records.groupBy(F.col("ref").alias("asked")).agg(F.max(F.col("error").isNull()).alias("known"), F.min("error").alias("error"))
    found = works.join(told, F.col("ref") == F.col("asked"), "left")
    known = F.coalesce("known", F.lit(False))
    bucket = F.when(F.col("ref").isNull(), "no_data").when(known, "updated").otherwise("errors" if live else "no_data")
    why = F.when(F.col("ref").isNull(), "no_identifier").when(~known, F.coalesce("error", F.lit("cache_miss")))
    return found.select("work", bucket.alias("bucket"), why.alias("why"))


def refreshed(stored_snapshots: DataFrame, works: DataFrame, records: DataFrame) -> DataFrame:
    """The stored snapshots with those of works that have an answer in their place; what has none is left untouched.

    ``stored_snapshots`` has ``work`` and the fields of ``records`` (``ref, error`` and any others).
    """
    fields = [c for c in records.columns if c not in ("ref", "error")]
    fresh = works.join(records.where("error is null"), "ref").select("work", *fields)
    return fresh.unionByName(stored_snapshots.join(fresh.select("work"), "work", "left_anti").select("work", *fields))


def with_quartiles(snapshots: DataFrame, quartiles: DataFrame) -> DataFrame:
    """``snapshots`` (``venue``) with ``quartiles``, a map from each category of the venue to its quartile; empty where the venue is unknown.

    ``quartiles`` has ``venue, category, quartile``, venues in lower case.
    """
    each = quartiles.groupBy(F.col("venue").alias("place")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("category", "quartile")))).alias("quartiles"))  # categories of one venue
    told = snapshots.join(each, F.lower("venue") == F.col("place"), "left").drop("place")
    return told.withColumn("quartiles", F.coalesce("quartiles", F.create_map().cast("map<string,string>")))


def citations_report(cards: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``work, recorded, fetched, delta`` of works whose snapshot knows citations; the card's text may carry a date after its number, and ``delta`` is n/a where there is none."""
    first = F.coalesce(F.element_at(F.split(F.trim("citations"), r"\s+"), 1), F.lit("?"))
    both = cards.select("work", F.when(first == "", "?").otherwise(first).alias("recorded")).join(snapshots.where("citations is not null").select("work", F.col("citations").alias("fetched")), "work")
    return both.withColumn("delta", F.coalesce((F.col("fetched") - F.col("recorded").try_cast("long")).cast("string"), F.lit("n/a")))


def agreement(cards: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``work, legacy, bands, agrees``: the band on a card against those of its categories; ``bands`` is null for a work without a snapshot."""
    each = verdicts.groupBy("work").agg(F.array_sort(F.collect_set("band")).alias("bands"))  # four bands at most
    return cards.join(each, "work", "left").select("work", "legacy", F.array_join("bands", "; ").alias("bands"), F.array_contains("bands", F.col("legacy")).alias("agrees"))


def coverage(agreed: DataFrame) -> DataFrame:
    """``works, covered, agreeing`` over ``agreement``."""
    return agreed.agg(F.count(F.lit(1)).alias("works"), F.count("bands").alias("covered"), F.count(F.when(F.col("agrees"), 1)).alias("agreeing"))


def attention_band(factor: Column, citations: Column, age: Column) -> Column:
    """The higher of the bands by impact factor and by citations for the age in years."""
    by_factor = F.when(factor >= 10, 3).when(factor >= 3, 2).otherwise(1)
    high = F.when(age < 1, 25).when(age <= 5, 50).otherwise(100)
    medium = F.when(age < 1, 10).otherwise(20)
    by_citations = F.when(citations >= high, 3).when(citations >= medium, 2).otherwise(1)
    best = F.greatest(by_factor, by_citations)
    return F.when(best == 3, "high").when(best == 2, "medium").otherwise("low")
