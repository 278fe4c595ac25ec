"""Mixing sources to target weights by Poisson replication (operator 8); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distributions of up to this many steps in all are broadcast; longer ones are joined by shuffling.
BROADCAST_STEPS = 1_000_000
#: Without weights, a source weighs its document count to this power.
POWER = 0.7
SEED = "mix-1"


def hashed_bits(digits: int, *parts: Column | str) -> Column:
    """``4 * digits`` bits of the MD5 of the parts, as a long."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, power: float = POWER, source_col: str = "source") -> DataFrame:
    """``source, n, rate``: documents, and mean copies of each that bring the source to its share of ``total``.

    ``weights`` has ``source, weight``; sources that it leaves out or gives null get weight 0.
    ``total`` is the wanted number of documents, by default as many as there are.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow("n", F.lit(power)))
    else:
        told = weights.groupBy(F.col("source").alias("told")).agg(F.sum("weight").alias("weight"))
        weighed = counts.join(told, F.col("source").eqNullSafe(F.col("told")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    wanted = F.lit(total).cast("double") if total is not None else F.col("all_n").cast("double")
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    return weighed.join(F.broadcast(sums)).select("source", "n", (share * wanted / F.col("n")).alias("rate"))  # `sums` is one row


def poisson_steps(rates: DataFrame) -> DataFrame:
    """``source, cdf``: P(X <= k) for k = 0, 1, ... until far beyond the mean; terms in logarithms, so any rate works.

    A source has as many rows as its rate needs, which running sums turn into its distribution.
    """
    last = F.when(F.col("rate") > 0, F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30)).otherwise(0).cast("int")
    order = Window.partitionBy("source").orderBy("k")
    steps = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    step = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))
    terms = steps.withColumn("term", F.exp(F.sum(step).over(order)))
    summed = terms.select("source", "k", F.sum("term").over(order).alias("c"))
    return summed.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))  # one source's steps


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, power: float = POWER, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``copy`` (from 1) and ``shuffle_key``, in the global order of ``shuffle_key``.

    Each document's number of copies inverts the Poisson distribution of its source's rate at a
    uniform number hashed from the seed and the id (a null id: its text), so a retried task repeats its
    choice.  A null source is a source of its own; repeated rows get the same number of copies; rows of a
    source of rate 0 have none; an empty table gives an empty result.  Columns of ``docs`` called ``copy``
    or ``shuffle_key`` are replaced, no others.
    """
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    own_text = F.col(f"`{text_col}`").cast("string") if text_col in docs.columns else F.lit(None).cast("string")
    id_text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(own_text, F.lit("")))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), F.col(f"`{source_col}`").alias("own_source"), id_text.alias("id_text"))
    steps = poisson_steps(source_rates(docs, weights, total, power, source_col))
    small = (steps.agg(F.sum(F.size("cdf"))).first()[0] or 0) <= BROADCAST_STEPS
    drawn = rows.withColumn("u", hashed_bits(13, F.lit(seed), "id_text") / F.lit(float(2**52)))
    drawn = drawn.join(F.broadcast(steps) if small else steps, F.col("own_source").eqNullSafe(F.col("source")))
    counted = drawn.select("own", "id_text", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).alias("n"))
    copies = counted.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    keyed = copies.withColumn("shuffle_key", hashed_bits(15, F.lit(seed), "id_text", "copy", F.lit("order")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.least(F.floor(F.col("shuffle_key") / F.lit(float(2**60)) * parts), F.lit(parts - 1)).cast("int")  # keys are uniform: no sampling pass
    ordered = keyed.repartitionById(parts, place).sortWithinPartitions("shuffle_key", "id_text")
    return ordered.select(*[F.col(f"own.`{c}`").alias(c) for c in columns], "copy", "shuffle_key")
