"""Retrieval over the graph of evidence: terms to nodes, corridors between domains, novelty of an idea.

``nodes`` have ``id, kind, label, axis, text``; ``parents`` ``child, parent``; ``edges`` ``kind, src, dst``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import has_word, question_terms
from lodestar.operators.graph import domain_closure, sides
from lodestar.sources.stored import stored

CANDIDATES, CORRIDORS, NOVEL_CORRIDORS, WORKS, CLAIMS, FOREIGN = 15, 15, 10, 15, 30, 3
SHARED_AXES = ("pattern", "function", "failure-mode")
ATTACHING = [*(f"tag:{a}" for a in SHARED_AXES), "concerns"]
ENDS = ["work", "gap"]


def clamp(cap: int, most: int) -> int:
    """A cap of at least one and at most ``most``."""
    return max(1, min(int(cap), most))


def query_terms(question: str, aliases: DataFrame | None = None, stopwords: list[str] | None = None) -> list[str]:
    """The question's terms, then each alias of ``aliases`` (``alias, slug``) that occurs in it and what it stands for.

    What comes to the driver is the aliases that one question holds.
    """
    found = question_terms(question, stopwords)
    if aliases is not None:
        text, alias = F.lit(question.lower()), F.lower("alias")
        plain = F.rlike(alias, F.lit("^[a-z0-9]+$"))
        whole = F.rlike(text, F.concat(F.lit("(?<![a-z0-9])"), alias, F.lit("(?![a-z0-9])")))
        here = aliases.where(F.when(plain, whole).otherwise(F.contains(text, alias))).select("slug", alias.alias("alias")).distinct().orderBy("slug", "alias")
        for row in here.collect():
            found += [row.alias, row.slug]
    return list(dict.fromkeys(found))


def term_hits(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """``id, kind, term``: terms that a node's text holds; terms are literals, so the scan joins nothing."""
    found = F.filter(F.array(*[F.when(has_word(F.col("text"), t), F.lit(t)) for t in terms] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    return nodes.select("id", "kind", F.explode(found).alias("term"))


def reached(nodes: DataFrame, parents: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """``node, term, reason``, each once: works and gaps by their own text, by their claims, and by concepts that they, or their claims, attach to or stand under."""
    hits = stored(term_hits(nodes, terms))
    because = F.concat(F.lit(" (term:"), F.col("term"), F.lit(")"))
    own = hits.where(F.col("kind").isin(ENDS)).select(F.col("id").alias("node"), "term", F.concat(F.lit("term:"), F.col("term")).alias("reason"))
    claimed = hits.where("kind = 'claim'").join(parents, F.col("id") == F.col("child")).select(F.col("parent").alias("node"), "term", F.concat(F.lit("claim:"), F.col("id"), because).alias("reason"))
    concepts = hits.where("kind in ('concept', 'domain')").select("id", "term", F.concat(F.lit("concept:"), F.col("id"), because).alias("reason"))
    pointed = concepts.join(edges, F.col("id") == F.col("dst")).select(F.col("src").alias("node"), "term", "reason")
    from_claims = pointed.where(F.startswith("node", F.lit("claim:"))).join(parents, F.col("node") == F.col("child")).select(F.col("parent").alias("node"), "term", "reason")
    below = concepts.join(parents, F.col("id") == F.col("parent")).select(F.col("child").alias("node"), "term", "reason")
    every = own.union(claimed).union(pointed).union(from_claims).union(below)
    ends = nodes.where(F.col("kind").isin(ENDS)).select(F.col("id").alias("node"))
    return every.distinct().join(ends, "node", "left_semi")


def reached_by_terms(nodes: DataFrame, parents: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """``node, reason`` of ``reached``, each once; a reason names its term."""
    return reached(nodes, parents, edges, terms).select("node", "reason")


class Bridges(NamedTuple):
    """What corridors between any two domains are made of, stored once for all that is asked of them."""

    #: ``via, domain`` of transfers that touch a domain, and ``via, ends`` (an array of ``kind, dst``).
    touched: DataFrame
    ends: DataFrame
    #: ``concept, axis, rank, domain, n, first`` of concepts of a shared axis.
    sides: DataFrame


def bridges(nodes: DataFrame, edges: DataFrame, closure: DataFrame) -> Bridges:
    """Transfers with the domains that their ends reach, and concepts of a shared axis with the works and gaps of each domain that attach."""
    moving = stored(edges.join(nodes.where("kind = 'transfer'").select(F.col("id").alias("src")), "src", "left_semi"))
    touched = stored(moving.join(closure, moving.dst == closure.node).select(F.col("src").alias("via"), "domain").distinct())
    ends = stored(moving.groupBy(F.col("src").alias("via")).agg(F.array_sort(F.collect_list(F.struct("kind", "dst"))).alias("ends")))  # one transfer's own edges
    rank = F.array_position(F.array(*map(F.lit, SHARED_AXES)), F.col("axis")).cast("int").alias("rank")
    concepts = nodes.where((F.col("kind") == "concept") & F.col("axis").isin(*SHARED_AXES)).select(F.col("id").alias("concept"), "axis", rank)
    sources = nodes.where(F.col("kind").isin(ENDS)).select(F.col("id").alias("node"))
    attached = edges.where(F.col("kind").isin(ATTACHING)).select(F.col("src").alias("node"), F.col("dst").alias("concept"))
    attached = attached.join(sources, "node", "left_semi").join(concepts.select("concept"), "concept", "left_semi")
    return Bridges(touched, ends, stored(sides(attached, closure).join(concepts, "concept")))


def corridors(found: Bridges, cap: int = CORRIDORS, pairs: DataFrame | None = None) -> DataFrame:
    """``a, c, place, kind, axis, via, ends, side_a, side_b, n_a, n_c, total, returned, truncated``: up to ``cap`` corridors of each pair of domains, ``a < c``.

    Transfers whose ends reach both domains come first, by id, with sides of 0; then concepts of a shared axis that works
    or gaps of both sides attach to, by axis and id.  ``ends``, ``side_a`` and ``side_b`` are arrays.  ``pairs`` (``a, c``) keeps
    some pairs only; nothing of other domains is paired at all.
    """
    cap, touched, counted = clamp(cap, CORRIDORS), found.touched, found.sides
    if pairs is not None:  # pairs of domains: a handful
        pairs = F.broadcast(pairs.distinct())
        wanted = F.broadcast(pairs.select(F.col("a").alias("domain")).union(pairs.select(F.col("c").alias("domain"))).distinct())
        touched, counted = touched.join(wanted, "domain", "left_semi"), counted.join(wanted, "domain", "left_semi")
    both = touched.alias("x").join(touched.alias("y"), "via").where("x.domain < y.domain").select("via", F.col("x.domain").alias("a"), F.col("y.domain").alias("c"))
    nothing = [F.lit(None).cast("array<string>").alias(c) for c in ("side_a", "side_b")] + [F.lit(0).cast("long").alias(c) for c in ("n_a", "n_c")]
    moved = both.join(found.ends, "via").select("a", "c", F.lit("transfer").alias("kind"), F.lit(None).cast("string").alias("axis"), F.lit(-1).alias("rank"), "via", "ends", *nothing)
    left = counted.select("concept", "axis", "rank", F.col("domain").alias("a"), F.col("first").alias("side_a"), F.col("n").alias("n_a"))
    right = counted.select("concept", F.col("domain").alias("c"), F.col("first").alias("side_b"), F.col("n").alias("n_c"))
    no_ends = F.lit(None).cast(found.ends.schema["ends"].dataType).alias("ends")
    shared = left.join(right, "concept").where("a < c").select("a", "c", F.lit("shared-axis").alias("kind"), "axis", "rank", F.col("concept").alias("via"), no_ends, "side_a", "side_b", "n_a", "n_c")

    every = moved.union(shared)
    every = every if pairs is None else every.join(pairs, ["a", "c"], "left_semi")
    total = every.groupBy("a", "c").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("a", "c").orderBy("rank", "via")
    first = every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).drop("rank")
    out = first.join(F.broadcast(total), ["a", "c"]).withColumn("returned", F.least("total", F.lit(cap).cast("long"))).withColumn("truncated", F.col("total") > cap)
    return out.select("a", "c", "place", "kind", "axis", "via", "ends", "side_a", "side_b", "n_a", "n_c", "total", "returned", "truncated")


def shown(found: DataFrame) -> DataFrame:
    """Corridors with their arrays as text."""
    return found.withColumns({
        "ends": F.array_join(F.transform("ends", lambda e: F.concat(e["kind"], F.lit("->"), e["dst"])), "|"),
        "side_a": F.array_join("side_a", "|"), "side_b": F.array_join("side_b", "|"),
    })


def hit_domains(reasons: DataFrame, closure: DataFrame) -> DataFrame:
    """``a, c``: pairs of the domains that what was found stands under; domains are a handful."""
    domains = reasons.join(closure, "node").select("domain").distinct()
    return domains.alias("x").join(F.broadcast(domains.alias("y")), F.col("x.domain") < F.col("y.domain")).select(F.col("x.domain").alias("a"), F.col("y.domain").alias("c"))


def sampled_ends(found: Bridges, pairs: DataFrame) -> DataFrame:
    """``a, c, node, reason``: the sampled ends of shared-axis corridors between the domains of each pair."""
    between = corridors(found, pairs=pairs).where("kind = 'shared-axis'")
    return between.select("a", "c", F.explode(F.concat("side_a", "side_b")).alias("node"), F.concat(F.lit("corridor:"), F.col("via")).alias("reason"))


def candidate_reasons(nodes: DataFrame, parents: DataFrame, edges: DataFrame, terms: list[str], closure: DataFrame | None = None, found: Bridges | None = None) -> DataFrame:
    """``node, reason``, each once: all that terms reach, and the sampled ends of shared-axis corridors between the domains that they hit."""
    closure = stored(domain_closure(parents)) if closure is None else closure
    found = bridges(nodes, edges, closure) if found is None else found
    reasons = stored(reached_by_terms(nodes, parents, edges, terms))
    sampled = sampled_ends(found, stored(hit_domains(reasons, closure)))
    return reasons.union(sampled.select("node", "reason")).distinct()


def ranked_candidates(reasons: DataFrame, cap: int = CANDIDATES) -> DataFrame:
    """``place, node, n, why`` of the ``cap`` nodes with most reasons, ties to the smaller id."""
    counted = reasons.groupBy("node").agg(F.count_distinct("reason").alias("n"))
    best = counted.orderBy(F.desc("n"), "node").limit(clamp(cap, CANDIDATES))
    why = reasons.join(F.broadcast(best), "node").groupBy("node", "n").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("why"))  # of ``cap`` nodes
    return why.select(F.row_number().over(Window.orderBy(F.desc("n"), "node")).alias("place"), "node", "n", "why")  # over ``cap`` rows


def research_order(reasons: DataFrame, cap: int = CANDIDATES) -> DataFrame:
    """``node, direct, n``: found by own text or claims before the others, then by number of reasons, then by id."""
    direct = F.max(F.startswith("reason", F.lit("term:")) | F.startswith("reason", F.lit("claim:")))
    return reasons.groupBy("node").agg(direct.alias("direct"), F.count_distinct("reason").alias("n")).orderBy(F.desc("direct"), F.desc("n"), "node").limit(clamp(cap, CANDIDATES))


def foreign_candidates(nodes: DataFrame, edges: DataFrame, closure: DataFrame, selected: DataFrame, stopwords: list[str] | None = None, cap: int = FOREIGN) -> DataFrame:
    """``node, via, local``: works outside ``selected`` (``node``) with a domain that it lacks, which share a concept of a shared axis with it.

    Each work comes with its first concept; ``local`` counts the selected nodes at that concept.
    """
    origins = selected.join(closure, "node").select("domain").distinct()
    concepts = nodes.where((F.col("kind") == "concept") & F.col("axis").isin(*SHARED_AXES)).select(F.col("id").alias("via"))
    concepts = concepts.where(~F.substring_index("via", ":", -1).isin(stopwords)) if stopwords else concepts
    attached = edges.where(F.col("kind").isin(ATTACHING)).select(F.col("dst").alias("via"), F.col("src").alias("node")).distinct().join(concepts, "via", "left_semi")
    local = attached.join(F.broadcast(selected), "node", "left_semi").groupBy("via").agg(F.count(F.lit(1)).alias("local"))
    outside = attached.join(local, "via").join(F.broadcast(selected), "node", "left_anti").join(nodes.where("kind = 'work'").select(F.col("id").alias("node")), "node", "left_semi")
    foreign = outside.join(closure, "node").join(F.broadcast(origins), "domain", "left_anti").groupBy("node").agg(F.min(F.struct("via", "local")).alias("first"))
    return foreign.select("node", "first.via", "first.local").orderBy("via", "node").limit(cap)


def novelty(nodes: DataFrame, parents: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """``stage, place, id, why, total, truncated``: up to 10 corridors, 15 closest works and 30 of their claims, each stage with its honest total.

    Corridors are those between the domains of the ranked candidates, one of each; works are candidates,
    then ends of the corridors, in order.
    """
    closure = stored(domain_closure(parents))
    built = bridges(nodes, edges, closure)
    hits = stored(ranked_candidates(candidate_reasons(nodes, parents, edges, terms, closure, built)))
    between = corridors(built, pairs=stored(hit_domains(hits, closure)))
    # one transfer may join several pairs of domains and counts once; sides differ from pair to pair
    once = between.withColumn("again", F.row_number().over(Window.partitionBy("kind", "via", "ends", "side_a", "side_b").orderBy("a", "c", "place"))).where("again = 1")
    found = stored(once.withColumn("at", F.row_number().over(Window.orderBy("a", "c", "place"))))  # at most CORRIDORS for each pair of a handful of domains
    n_corridors = found.count()
    kept = found.where(F.col("at") <= NOVEL_CORRIDORS)

    work = nodes.where("kind = 'work'").select(F.col("id").alias("node"))
    because = F.concat(F.lit("corridor:"), F.col("via"))
    none_there = F.array().cast("array<string>")
    touched = F.concat(F.coalesce("side_a", none_there), F.coalesce("side_b", none_there), F.coalesce(F.transform("ends", lambda e: e["dst"]), none_there))
    at_ends = kept.select("at", because.alias("why"), F.posexplode(touched).alias("k", "node"))
    every = hits.select(F.lit(0).alias("at"), "why", F.col("place").alias("k"), "node").union(at_ends.select("at", "why", "k", "node"))
    first = every.join(work, "node", "left_semi").groupBy("node").agg(F.min(F.struct("at", "k", "why")).alias("f"))
    works = stored(first.select("node", "f.why", F.row_number().over(Window.orderBy("f.at", "f.k")).alias("place")))  # ends of a bounded number of corridors
    n_works = works.count()
    works = works.where(F.col("place") <= WORKS)

    claims = stored(edges.where("kind = 'claims'").join(F.broadcast(works), F.col("src") == F.col("node")).select("dst", "place"))
    n_claims = claims.count()
    first_claims = claims.orderBy("place", "dst").limit(CLAIMS).select(F.row_number().over(Window.orderBy("place", "dst")).alias("at"), "dst")

    def stage(name: str, frame: DataFrame, place: str, item: str | Column, why: Column, total: int, cap: int) -> DataFrame:
        return frame.select(F.lit(name).alias("stage"), F.col(place).alias("place"), F.col(item).alias("id"), why.alias("why"), F.lit(total).cast("long").alias("total"), F.lit(total > cap).alias("truncated"))

    none = F.lit(None).cast("string")
    return stage("corridors", kept, "at", "via", F.concat_ws(" ", "a", "c"), n_corridors, NOVEL_CORRIDORS).union(stage("works", works, "place", "node", F.col("why"), n_works, WORKS)).union(stage("claims", first_claims, "at", "dst", none, n_claims, CLAIMS))
