"""Bounded expansion over bibliographic neighbours: levels in order, a budget of new candidates, and the pool they gather in."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources.stored import stored

DEPTH, MAX_NEW, EXPLORATORY = 2, 50, 2
#: The directions of a neighbour, in the order in which they are walked.
DIRECTIONS = ("references", "cited_by")


def pool(discoveries: DataFrame) -> DataFrame:
    """``key, title, year, doi, openalex, verified, n_occurrences``: one row for each candidate of ``discoveries``.

    ``discoveries`` has ``seq`` and those of a record and where it was found (``via, direction, depth``).  The first
    known title, and each identifier's first value, stay; one with any identifier is verified; equal occurrences count once.
    """

    def first(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)

    occurrence = F.count_distinct(F.struct("via", "direction", "depth")).alias("n_occurrences")
    merged = discoveries.where("key is not null").groupBy("key").agg(first("title"), F.min(F.struct("seq", "year"))["year"].alias("year"), first("doi"), first("openalex"), occurrence)
    return merged.select("key", "title", "year", "doi", "openalex", (F.col("doi").isNotNull() | F.col("openalex").isNotNull()).alias("verified"), "n_occurrences")


class Level(NamedTuple):
    """What one level of a walk met, up to where the budget ended."""

    #: ``kind, item, via, direction, depth, at``: ``new`` candidates, ``unverified`` ones, ``hit`` works of the library.
    found: DataFrame
    #: ``key, via, direction, depth, at`` of every candidate met, new or not.
    met: DataFrame
    #: ``warning``: nodes without identifiers, and nodes of which a neighbour was dropped.
    warnings: DataFrame
    #: ``node`` of those walked to their end, and ``node, at`` of what is to be walked next.
    expanded: DataFrame
    frontier: DataFrame
    #: New verified candidates.
    used: int


def level(frontier: DataFrame, neighbours: DataFrame, depth: int, left: int, known: DataFrame | None = None, walked: DataFrame | None = None, identified: DataFrame | None = None, last: bool = False) -> Level:
    """Walk the nodes of ``frontier`` (``node, at``), until ``left`` new verified candidates came up.

    ``neighbours`` has ``node, direction, place, key, verified, slug``: references come before what cites, each in order of
    ``place``; ``slug`` names a work of the library that the record is, ``key`` identifies any other.  ``at`` is the path of
    places that leads to a row, so comparing paths is the order of a first-in first-out walk, and nothing is numbered.  A
    candidate counts when it is new to ``known`` (``key``) and verified where first met; the others are kept but use no
    budget.  ``walked`` (``node``) are never queued again, and the ``last`` level queues nothing; nodes that are not ``identified``, if given, are skipped.
    """
    able = frontier if identified is None else frontier.join(identified.select("node"), "node", "left_semi")
    rank = F.when(F.col("direction") == DIRECTIONS[0], 0).otherwise(1).cast("long")
    place = F.concat("at", F.array(rank, F.col("place").cast("long")))
    met = stored(able.join(neighbours, "node").select(place.alias("at"), F.col("node").alias("via"), "direction", "key", F.coalesce("verified", F.lit(False)).alias("verified"), "slug"))
    candidates = met.where("slug is null and key is not null")
    first = candidates.groupBy("key").agg(F.min(F.struct("at", "verified", "via", "direction")).alias("x"))
    first = stored(first if known is None else first.join(known.select("key"), "key", "left_anti"))
    new = first.where("x.verified").orderBy("x.at").limit(left)
    ends = new.select("x.at").collect()  # the budget's length
    within, done = F.lit(True), F.lit(True)
    if len(ends) == left:  # the walk ends at this place: nothing after it was met, and its node is not walked to the end
        cut = [F.lit(x).cast("long") for x in ends[-1]["at"]]
        within, done = F.col("at") <= F.array(*cut), F.col("at") < F.array(*cut[:-2])

    def row(kind: str, item: str, of: str) -> list[Column]:
        return [F.lit(kind).alias("kind"), F.col(item).alias("item"), *[F.col(f"{of}{c}").alias(c) for c in ("via", "direction")], F.lit(depth).alias("depth"), F.col(f"{of}at").alias("at")]

    hits = met.where(F.col("slug").isNotNull() & within).groupBy("slug", "via", "direction").agg(F.min("at").alias("at"))
    found = hits.select(*row("hit", "slug", "")).union(first.select(*row("new", "key", "x."), F.col("x.verified").alias("verified")).withColumn("kind", F.when(F.col("verified"), "new").otherwise("unverified")).drop("verified").where(within))
    dropped = met.where(F.col("slug").isNull() & F.col("key").isNull() & within).select(F.concat(F.lit("unidentifiable:"), "via").alias("warning")).distinct()
    skipped = frontier.join(able.select("node"), "node", "left_anti").where(done).select(F.concat(F.lit("no_ids:"), "node").alias("warning"))
    fresh = hits.groupBy(F.col("slug").alias("node")).agg(F.min("at").alias("at"))
    fresh = fresh if walked is None else fresh.join(walked.select("node"), "node", "left_anti")
    behind = frontier.where(F.col("at") > F.array(*cut[:-2])) if len(ends) == left else frontier.limit(0)
    queue = behind.select("node", "at") if last else behind.select("node", "at").union(fresh.select("node", "at"))
    return Level(found, candidates.where(within).select("key", "via", "direction", F.lit(depth).alias("depth"), "at"), dropped.union(skipped), able.where(done).select("node"), queue, len(ends))


def expand(seeds: DataFrame, neighbours: DataFrame, depth: int = DEPTH, max_new: int = MAX_NEW, known: DataFrame | None = None) -> DataFrame:
    """``kind, item, via, direction, depth, at`` of a whole walk (see ``level``), without state; ``seeds`` have ``node, seq``.

    Hits walk on while depth remains; candidates never do.  The walk ends where the ``max_new``-th new verified key comes up.
    """
    frontier = stored(seeds.groupBy("node").agg(F.array(F.min("seq").cast("long")).alias("at")))
    walked, used, out = frontier.select("node"), 0, None
    for n in range(1, depth + 1):
        met = level(frontier, neighbours, n, max_new - used, known, walked)
        found = stored(met.found)
        out, used = found if out is None else out.union(found), used + met.used
        if used >= max_new or n == depth:
            break
        own = found.where("kind <> 'hit'").select(F.col("item").alias("key"))
        known = own if known is None else known.select("key").union(own)
        frontier = stored(met.frontier)
        walked = walked.union(frontier.select("node"))
    return out


def stop_reason(found: DataFrame, max_new: int = MAX_NEW) -> str:
    """Why a walk ended."""
    return "budget_reached" if found.where("kind = 'new'").count() >= max_new else "frontier_exhausted"


def budget(found: DataFrame, max_new: int = MAX_NEW) -> DataFrame:
    """``max_new, used, stop_reason`` of a walk: one row."""
    used = F.count(F.when(F.col("kind") == "new", 1))
    return found.agg(F.lit(max_new).alias("max_new"), used.alias("used"), F.when(used >= max_new, "budget_reached").otherwise("frontier_exhausted").alias("stop_reason"))


def review_batch(found: DataFrame, candidates: DataFrame, decisions: DataFrame, scope: str, max_new: int = MAX_NEW) -> DataFrame:
    """``key, title, n_occurrences, decision, max_new, used, stop_reason``: the new verified candidates of a walk, what the scope decided before, and the budget."""
    new = found.where("kind = 'new'").select(F.col("item").alias("key"))  # MAX_NEW at most
    told = decisions.where(F.col("scope") == scope).select("key", "decision")
    batch = candidates.join(F.broadcast(new), "key", "left_semi").join(told, "key", "left").select("key", "title", "n_occurrences", "decision")
    return batch.crossJoin(F.broadcast(budget(found, max_new)))  # one row


def apply_decisions(stored_decisions: DataFrame, made: DataFrame, batch: DataFrame, scope: str) -> DataFrame:
    """``key, scope, decision, exploratory``: decisions of a scope with those ``made`` (``key, decision, exploratory``), the newest of each key.

    Decisions outside the ``batch`` (``key``) and more than two selected exploratory candidates in all are errors.
    """
    if not made.join(batch, "key", "left_anti").isEmpty():
        raise ValueError("outside_batch")
    own = stored_decisions.where(F.col("scope") == scope).join(made.select("key"), "key", "left_anti").select("key", "scope", "decision", "exploratory")
    after = own.union(made.select("key", F.lit(scope), "decision", "exploratory"))
    picked = after.join(batch, "key", "left_semi").where("exploratory and decision = 'selected'")
    if picked.count() > EXPLORATORY:
        raise ValueError("exploratory_cap")
    return after.union(stored_decisions.where(F.col("scope") != scope).select("key", "scope", "decision", "exploratory"))


def merge_pools(shared: DataFrame, run: DataFrame) -> DataFrame:
    """The shared pool with a run's candidates, which are newer, in place of its own of the same keys."""
    return run.unionByName(shared.join(run.select("key"), "key", "left_anti"))


def citation_overlay(works: DataFrame, records: DataFrame, references: DataFrame) -> DataFrame:
    """``src, dst``: which works cite which, each pair once, none itself.

    ``works`` has ``work, doi``, ``records`` ``doi, record``, ``references`` ``record, cited`` (records both).  DOIs are
    compared in lower case; works that share one are left out.
    """
    ids = works.where("doi is not null").select("work", F.lower("doi").alias("doi"))
    once = ids.groupBy("doi").agg(F.count(F.lit(1)).alias("n"), F.first("work").alias("work")).where("n = 1").select("doi", "work")
    known = stored(once.join(records.select(F.lower("doi").alias("doi"), "record"), "doi").select("work", "record").distinct())
    src = known.select(F.col("work").alias("src"), "record")
    dst = known.select(F.col("work").alias("dst"), F.col("record").alias("cited"))
    return references.join(src, "record").join(dst, "cited").where("src <> dst").select("src", "dst").distinct()
