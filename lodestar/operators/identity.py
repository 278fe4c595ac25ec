"""Who is who: duplicate identifiers, prioritised look-ups, and fuzzy titles."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import normal_title
from lodestar.sources.stored import stored

RATIO = 0.92


def duplicates(items: DataFrame, identity: str, key: str) -> DataFrame:
    """``identity, n, first_key`` of identities that several items have."""
    found = items.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.countDistinct(key).alias("n"), F.min(key).alias("first_key"))
    return found.where("n > 1")


def look_up(records: DataFrame, index: DataFrame, kinds: list[str], key: str) -> DataFrame:
    """``key, slug``: each record's hit by the first kind of identifier that has one.

    ``index`` has ``kind, value, slug``; values are compared in lower case.
    """
    rank = {k: i for i, k in enumerate(kinds)}
    ids = records.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(rank[k]).alias("rank"), F.lower(F.col(k).cast("string")).alias("value")) for k in kinds])).alias("x"))
    hits = ids.select(key, "x.*").join(index.select("kind", F.lower("value").alias("value"), "slug"), ["kind", "value"])
    return hits.groupBy(key).agg(F.min(F.struct("rank", "slug")).alias("best")).select(key, F.col("best.slug").alias("slug"))


def title_bounds(titles: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``ta, tb, bound``: pairs of different titles (``t``, distinct, ``ta < tb``) whose sequence-matching ratio may be ``ratio`` or more.

    2 * min / (a + b) bounds the ratio, so lengths differ by a bounded factor and titles meet only in equal or
    neighbouring length bands; twice the common characters, counted with repetition, over both lengths bounds it closer.
    """
    step = math.log((2 - ratio) / ratio)
    chars = F.split("t", "")
    counts = F.map_from_entries(F.transform(F.array_distinct("chars"), lambda c: F.struct(c, F.size(F.filter("chars", lambda x: x == c)))))
    base = titles.where(F.length("t") > 0).select("t", F.filter(chars, lambda c: c != "").alias("chars"), F.floor(F.log(F.length("t").cast("double")) / F.lit(step)).alias("band"))
    base = base.select("t", "band", F.length("t").alias("n"), counts.alias("counts"))
    near = base.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    pairs = base.alias("x").join(near.alias("y"), "band").where("x.t < y.t")
    common = F.aggregate(F.map_values(F.map_zip_with("x.counts", "y.counts", lambda k, a, b: F.least(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))))), F.lit(0), lambda n, c: n + c)
    both = F.col("x.n") + F.col("y.n")
    lengths = 2 * F.least("x.n", "y.n") / both >= ratio
    return pairs.where(lengths).select(F.col("x.t").alias("ta"), F.col("y.t").alias("tb"), (2 * common / both).alias("bound")).where(F.col("bound") >= ratio)


def _matches(bounds: DataFrame, ratio: float) -> DataFrame:
    """``ta, tb, score`` of title pairs that ``bounds`` leave open and whose ratio is ``ratio`` or more."""

    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(a, b, strict=True)], dtype="float64")

    match = F.pandas_udf(matched, T.DoubleType())
    # the order of the two texts can change the ratio; both are tried
    return bounds.select("ta", "tb", F.greatest(match("ta", "tb"), match("tb", "ta")).alias("score")).where(F.col("score") >= ratio)


def title_classes(items: DataFrame, key: str, title: str, ratio: float = RATIO) -> DataFrame:
    """``kind, a, b, score``: similar titles without a row for each pair of items of equal titles.

    Items of one normalised title are a class, named by its least key.  A ``member`` row tells the class ``a`` of each item
    ``b`` with a key and a title (score 1), a ``similar`` row two classes, in order, whose titles match as in ``similar_titles``:
    its pairs are those within a class and those between items of two similar classes.
    """
    base = stored(items.select(F.col(key).alias("k"), normal_title(title).alias("t")).where("t <> '' and k is not null"))
    classes = stored(base.groupBy("t").agg(F.min("k").alias("c")))
    members = base.join(classes, "t").select(F.lit("member").alias("kind"), F.col("c").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("score"))
    told = _matches(title_bounds(classes.select("t"), ratio), ratio)
    named = told.join(classes.select(F.col("t").alias("ta"), F.col("c").alias("x")), "ta").join(classes.select(F.col("t").alias("tb"), F.col("c").alias("y")), "tb")
    return members.union(named.select(F.lit("similar"), F.least("x", "y"), F.greatest("x", "y"), "score"))


def similar_titles(items: DataFrame, key: str, title: str, ratio: float = RATIO, among: DataFrame | None = None) -> DataFrame:
    """``a, b, score``: pairs of items whose normalised titles have a sequence-matching ratio of ``ratio`` or more, keys in order.

    Each different title is compared once, and only where ``title_bounds`` leave it open; the match itself is Arrow
    batches, as Spark has no such function.  Items without a title are in no pair.  ``among`` (``k``) keeps pairs of which one
    item is among these.
    """
    base = stored(items.select(F.col(key).alias("k"), normal_title(title).alias("t")).where("t <> ''"))
    bounds = title_bounds(base.select("t").distinct(), ratio)
    if among is not None:
        mine = stored(base.join(among.select("k"), "k", "left_semi").select(F.col("t").alias("own")).distinct())
        bounds = bounds.join(mine, F.col("ta") == F.col("own"), "left_semi").union(bounds.join(mine, F.col("tb") == F.col("own"), "left_semi")).distinct()
    told = _matches(bounds, ratio)
    told = stored(told.union(told.select("tb", "ta", "score")))
    equal = base.alias("x").join(base.alias("y"), "t").where("x.k < y.k").select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.lit(1.0).alias("score"))
    other = told.join(base.select(F.col("k").alias("a"), F.col("t").alias("ta")), "ta").join(base.select(F.col("k").alias("b"), F.col("t").alias("tb")), "tb").where("a < b")
    pairs = equal.union(other.select("a", "b", "score"))
    if among is None:
        return pairs
    mine = among.select("k").distinct()
    return pairs.join(mine, F.col("a") == F.col("k"), "left_semi").union(pairs.join(mine, F.col("b") == F.col("k"), "left_semi")).distinct()
