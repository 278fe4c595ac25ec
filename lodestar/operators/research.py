"""The research context: what is understood of a topic now, and the bounded evidence to read for it.

Nodes have ``id, kind, label, axis, text``, briefs among them; ``parents`` ``child, parent``; ``edges`` ``kind, src, dst``.
``relations`` (``kind, src, dst``) are evidence relations of claims or works with gaps or claims, ``briefs``
``id, topic, view, date``, ``synthesis`` ``node, place, entry, ref``: what each judgment of a card rests on.

Of every lane no more than the first ``CAP`` places are kept before lanes meet, so however long a lane is, what is
ranked together is a few rows for each lane.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import retrieval
from lodestar.operators.evidence import pending_for, work_of
from lodestar.operators.graph import domain_closure
from lodestar.sources.stored import stored

CAP, BRIEFS, ALTERNATIVES = 15, 3, 2


class Graph(NamedTuple):
    """The tables that a research context reads."""

    nodes: DataFrame
    parents: DataFrame
    edges: DataFrame
    relations: DataFrame
    briefs: DataFrame
    synthesis: DataFrame


def query_reasons(graph: Graph, terms: list[list[str]], closure: DataFrame, built: retrieval.Bridges) -> DataFrame:
    """``q, node, reason``, each once, of all queries in one pass: ``terms`` are those of each query, in order."""
    spark = graph.nodes.sparkSession
    asked = F.broadcast(spark.createDataFrame([(q, t) for q, own in enumerate(terms) for t in own], "q int, term string"))  # terms of three questions
    every = list(dict.fromkeys(t for own in terms for t in own))
    found = stored(retrieval.reached(graph.nodes, graph.parents, graph.edges, every).join(asked, "term").select("q", "node", "reason").distinct())
    domains = found.select("q", "node").distinct().join(closure, "node").select("q", "domain").distinct()
    pairs = domains.alias("x").join(F.broadcast(domains.alias("y")), (F.col("x.q") == F.col("y.q")) & (F.col("x.domain") < F.col("y.domain")))  # a handful of domains
    pairs = stored(pairs.select(F.col("x.q").alias("q"), F.col("x.domain").alias("a"), F.col("y.domain").alias("c")))
    sampled = retrieval.sampled_ends(built, pairs.select("a", "c")).join(F.broadcast(pairs), ["a", "c"])
    return found.union(sampled.select("q", "node", "reason")).distinct()


def pools(reasons: DataFrame, cap: int = CAP) -> DataFrame:
    """``q, place, node``: the first ``cap`` nodes of each query, those found by own text or claims first, then by number of reasons, then by id."""
    direct = F.max(F.startswith("reason", F.lit("term:")) | F.startswith("reason", F.lit("claim:"))).alias("direct")
    counted = reasons.groupBy("q", "node").agg(direct, F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("q").orderBy(F.desc("direct"), F.desc("n"), "node")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("q", "place", "node")


def current_briefs(graph: Graph, terms: list[str], matched: DataFrame, cap: int = BRIEFS) -> DataFrame:
    """``node, date``: the newest ``cap`` of the latest briefs of each topic and view that hold a term, or rest on something ``matched`` (``node``) or on its claims."""
    judged = graph.synthesis.select(F.col("node").alias("id")).distinct()
    scope = F.struct(F.coalesce("topic", "id").alias("topic"), F.coalesce("view", F.lit("")).alias("view"))
    latest = graph.briefs.join(judged, "id", "left_semi").groupBy(scope.alias("scope")).agg(F.max(F.struct(F.coalesce("date", F.lit("")).alias("date"), "id")).alias("x"))
    latest = stored(latest.select(F.col("x.id").alias("node"), F.col("x.date").alias("date")))
    said = retrieval.term_hits(graph.nodes.where("kind = 'brief'"), terms).select(F.col("id").alias("node"))
    rests = graph.synthesis.join(latest, "node", "left_semi").select("node", F.explode(F.array("ref", work_of(F.col("ref")))).alias("ref"))
    rests = rests.join(matched.select(F.col("node").alias("ref")), "ref", "left_semi").select("node")
    return latest.join(said.union(rests).distinct(), "node", "left_semi").orderBy(F.desc("date"), F.desc("node")).limit(cap)


def evidence_lanes(graph: Graph, first: DataFrame) -> DataFrame:
    """``card, list, node, at``: works behind the judgments of the cards ``first`` (``card, node``, a few), and the sources of gaps among them.

    Each judgment is a list of its own, in order; works within it come in the order of what first names them.
    """
    first = F.broadcast(first)
    claims = graph.nodes.where("kind = 'claim'").select(F.col("id").alias("ref"))
    judged = graph.synthesis.join(first, "node").where("ref like 'claim:%'").join(claims, "ref", "left_semi")
    judged = judged.select("card", F.struct(F.lit(0).alias("kind"), F.col("place").cast("long").alias("place"), "entry").alias("list"), work_of(F.col("ref")).alias("node"), F.col("ref").alias("at"))
    gaps = first.where("node like 'gap:%'").select("card", F.col("node").alias("dst"))
    into = graph.relations.join(F.broadcast(gaps), "dst").where("src like 'claim:%' or src like 'work:%'")
    into = into.select("card", F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("place"), F.lit("").alias("entry")).alias("list"), F.coalesce(work_of(F.col("src")), "src").alias("node"), F.concat_ws("|", "src", "kind", "dst").alias("at"))
    return judged.union(into).groupBy("card", "list", "node").agg(F.min("at").alias("at"))


def research_context(graph: Graph, topic: str, alternatives: list[str] | None = None, aliases: DataFrame | None = None, bridge_stopwords: list[str] | None = None) -> dict[str, DataFrame]:
    """The sections of a context, each a small frame but for claims and relations of the works that were selected.

    ``candidates`` (``place, node, why``): the latest briefs, the first of each query's pool, then works behind their
    judgments in turn, then the pools in turn; each node where it first comes up, ``CAP`` in all.  Nothing past that
    budget is read: gaps beyond it are ``related_gaps``, what judgments rest on beyond it ``unread_dependencies``.
    """
    spark = graph.nodes.sparkSession
    queries = list(dict.fromkeys([topic, *(alternatives or [])[:ALTERNATIVES]]))
    terms = [retrieval.query_terms(q, aliases) for q in queries]
    closure = stored(domain_closure(graph.parents))
    built = retrieval.bridges(graph.nodes, graph.edges, closure)
    reasons = stored(query_reasons(graph, terms, closure, built))
    pool = stored(pools(reasons))
    hits = {r.q: r.n for r in reasons.groupBy("q").agg(F.count_distinct("node").alias("n")).collect()}

    briefs = [r.node for r in current_briefs(graph, [t for own in terms for t in own], reasons.select("node").distinct()).collect()]
    heads = [r.node for r in pool.where("place = 1").orderBy("q").collect()]
    first = list(dict.fromkeys(briefs + heads))  # six at most
    lanes = stored(evidence_lanes(graph, spark.createDataFrame(list(enumerate(first)), "card int, node string")))
    in_turn = lanes.withColumn("turn", F.row_number().over(Window.partitionBy("card", "list").orderBy("at"))).where(F.col("turn") <= CAP)

    def lane(frame: DataFrame, phase: int, turn: str | Column, of: Column) -> DataFrame:
        return frame.select("node", F.struct(F.lit(phase).alias("phase"), F.col(turn).alias("turn") if isinstance(turn, str) else turn.alias("turn"), of.alias("of")).alias("at"))

    of = lambda a, b: F.struct(a.cast("int").alias("card"), b.alias("list"))
    no_list = F.lit(None).cast(lanes.schema["list"].dataType)
    fixed = spark.createDataFrame([(i, n) for i, n in enumerate(first)], "i int, node string")
    every = reduce(DataFrame.union, [lane(fixed, 0, "i", of(F.lit(0), no_list)), lane(in_turn, 1, "turn", of(F.col("card"), F.col("list"))), lane(pool, 2, "place", of(F.col("q"), no_list))])
    chosen = every.groupBy("node").agg(F.min("at").alias("at")).orderBy("at").limit(CAP).collect()
    selected = F.broadcast(spark.createDataFrame([(i, r.node) for i, r in enumerate(chosen, 1)], "place int, node string"))
    ids = selected.select("node")

    why = reduce(DataFrame.union, [
        reasons.join(ids, "node", "left_semi").select("node", "reason"), reasons.join(ids, "node", "left_semi").select("node", F.lit("query-match")),
        lanes.join(ids, "node", "left_semi").select("node", F.lit("synthesis-dependency")), spark.createDataFrame([(b, "current-synthesis") for b in briefs], "node string, reason string"),
    ])
    why = why.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("why"))  # of ``CAP`` nodes

    def of_kind(kind: str) -> DataFrame:
        return graph.nodes.where(F.col("kind") == kind).join(ids, F.col("id") == F.col("node"), "left_semi").select(F.col("id").alias("node"), "label")

    claims = stored(graph.nodes.where("kind = 'claim'").join(graph.parents, F.col("id") == F.col("child")).join(ids, F.col("parent") == F.col("node"), "left_semi").select("id", "label").distinct())
    relations = stored(graph.relations.join(claims.select(F.col("id").alias("src")), "src", "left_semi").select("src", "kind", "dst"))
    refs = graph.synthesis.join(ids, "node", "left_semi").select("ref")
    gap_nodes = graph.nodes.where("kind = 'gap'").select(F.col("id").alias("ref"))
    named = refs.union(relations.select("dst")).where("ref like 'gap:%'").join(gap_nodes, "ref", "left_semi").select(F.col("ref").alias("node"))
    gaps = stored(named.union(ids.where("node like 'gap:%'")).distinct())
    needed = refs.union(relations.where("dst like 'claim:%'").select("dst")).distinct()
    unread = needed.join(claims.select(F.col("id").alias("ref")), "ref", "left_anti").join(ids.select(F.col("node").alias("ref")), "ref", "left_anti")
    return {
        "attempts": spark.createDataFrame([(i, q, hits.get(i, 0)) for i, q in enumerate(queries)], "place int, query string, hits long"),
        "candidates": selected.join(why, "node").select("place", "node", "why"),
        "works": of_kind("work"), "current_syntheses": of_kind("brief"), "claims": claims.select(F.col("id").alias("node"), "label"), "relations": relations,
        "gaps": gaps.join(ids, "node", "left_semi"), "related_gaps": gaps.join(ids, "node", "left_anti"), "unread_dependencies": unread.select(F.col("ref").alias("node")),
        "cross_domain": retrieval.foreign_candidates(graph.nodes, graph.edges, closure, ids, bridge_stopwords),
        "coverage": spark.createDataFrame([("candidate-set-only" if chosen else "no-candidates",)], "coverage string"),
    }


def as_rows(context: dict[str, DataFrame]) -> DataFrame:
    """``section, item, detail``: all sections below each other."""
    text = lambda *cs: F.concat_ws(" ", *cs)
    parts = {
        "attempts": ("query", F.col("hits").cast("string")), "candidates": ("node", text(F.col("place").cast("string"), F.col("why"))),
        "works": ("node", F.col("label")), "current_syntheses": ("node", F.col("label")), "claims": ("node", F.col("label")),
        "relations": ("src", text(F.col("kind"), F.col("dst"))), "gaps": ("node", F.lit("")), "related_gaps": ("node", F.lit("")), "unread_dependencies": ("node", F.lit("")),
        "cross_domain": ("node", text(F.col("via"), F.col("local").cast("string"))), "coverage": ("coverage", F.lit("")),
    }
    return reduce(DataFrame.union, [context[name].select(F.lit(name).alias("section"), F.col(item).alias("item"), detail.alias("detail")) for name, (item, detail) in parts.items()])


def pending(context: dict[str, DataFrame], updates: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Pending ``updates`` of what the context holds, or of judgments that depend on it."""
    held = reduce(DataFrame.union, [context[name].select("node") for name in ("works", "gaps", "current_syntheses")])
    return pending_for(updates, dependencies, held)


def graph_of(tables: dict[str, DataFrame]) -> Graph:
    """A ``Graph`` of stored tables."""
    return Graph(**{name: stored(tables[name]) for name in Graph._fields})
