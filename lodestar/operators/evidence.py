"""Changes of evidence between two snapshots, the judgments they touch, and the state of their reviews.

Nodes have ``id, kind, mark, context`` (hashes or values of what counts as their content), edges
``kind, src, dst, mark``, dependencies ``node_id, entry, ref``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.change import affected
from lodestar.operators.ranking import round_robin
from lodestar.sources.stored import stored

DECISIONS = ("retain", "revise", "withdraw")
# What a review of a changed edge is asked to look at.
ADVICE = {
    "gone": "review judgment after evidence relation removal", "disputes": "review whether to question the judgment",
    "reframes": "review scope and whether to narrow the judgment", "narrower_than": "review scope and whether to narrow the judgment",
    "different_question": "review scope and whether to narrow the judgment",
    "supports": "review whether evidence strengthens the judgment within its conditions", "partially_addresses": "review whether evidence strengthens the judgment within its conditions",
}
ANY_CHANGE, NO_CHANGE, BY_GAP = "review changed evidence and applicability", "retain judgment; no dependency change detected", "review dependent Gap judgment after evidence changes"


def work_of(claim: Column) -> Column:
    """The work that a claim's id names."""
    return F.when(F.startswith(claim, F.lit("claim:")), F.concat(F.lit("work:"), F.substring_index(F.substring(claim, 7, 1 << 20), "#", 1)))


def edge_id(src: str = "src", kind: str = "kind", dst: str = "dst") -> Column:
    return F.concat_ws("|", src, kind, dst)


def changed_nodes(before: DataFrame, after: DataFrame, parents: DataFrame) -> DataFrame:
    """``node``: what was added, removed or differs; claims of works whose context differs; works of changed claims.

    ``parents`` (``child, parent``) are those of both snapshots.
    """
    old = before.select("id", F.col("kind").alias("old_kind"), F.col("mark").alias("old"), F.col("context").alias("old_context"), F.lit(True).alias("was"))
    new = after.select("id", F.col("kind").alias("new_kind"), F.col("mark").alias("new"), F.col("context").alias("new_context"), F.lit(True).alias("is"))
    both = old.join(new, "id", "full_outer")
    other_context = ~F.col("old_context").eqNullSafe(F.col("new_context"))
    differs = F.col("was").isNull() | F.col("is").isNull() | ~F.col("old").eqNullSafe(F.col("new")) | other_context
    changed = stored(both.where(differs).select(F.col("id").alias("node"), ((F.coalesce("new_kind", "old_kind") == "work") & other_context).alias("context")))
    claims = parents.where(F.startswith("child", F.lit("claim:"))).join(changed.where("context").select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node"))
    direct = changed.select("node").union(claims)
    return direct.union(direct.select(work_of(F.col("node")).alias("node")).where("node is not null")).distinct()


def changed_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """``edge, kind, src, dst, gone`` of edges that only one snapshot has, or whose content differs."""
    old = before.select(edge_id().alias("edge"), "kind", "src", "dst", F.col("mark").alias("old"), F.lit(True).alias("was"))
    new = after.select(edge_id().alias("edge"), F.col("mark").alias("new"), F.lit(True).alias("is"), F.col("kind").alias("k"), F.col("src").alias("s"), F.col("dst").alias("d"))
    both = old.join(new, "edge", "full_outer").where(F.col("was").isNull() | F.col("is").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    return both.select("edge", F.coalesce("kind", "k").alias("kind"), F.coalesce("src", "s").alias("src"), F.coalesce("dst", "d").alias("dst"), F.col("is").isNull().alias("gone"))


def touched(dependencies: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, entry, edge, kind, gone``, each once: changed edges whose ends, or whose claim's work, a judgment depends on.

    Three equi-joins in place of one join on alternatives.
    """
    edges = edges.where("kind <> 'depends_on'")
    keys = reduce(DataFrame.union, [edges.select("edge", "kind", "gone", c.alias("ref")) for c in (F.col("src"), F.col("dst"), work_of(F.col("src")))])
    return dependencies.join(keys.where("ref is not null"), "ref").select("node_id", "entry", "edge", "kind", "gone").distinct()


def evidence_changes(dependencies: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, entry, changed_nodes, changed_edges, affected, suggestions`` of every judgment, affected or not.

    ``nodes`` and ``edges`` are what changed.  A judgment on a gap depends on the gap itself; an affected gap
    affects what depends on it, until nothing more is reached.
    """
    own = dependencies.where(F.startswith("node_id", F.lit("gap:"))).select("node_id", "entry", F.col("node_id").alias("ref"))
    refs = stored(dependencies.select("node_id", "entry", "ref").union(own).distinct())
    by_node = refs.join(nodes.select(F.col("node").alias("ref")), "ref", "left_semi").groupBy("node_id", "entry").agg(F.count(F.lit(1)).alias("changed_nodes"))
    hit = touched(refs, edges)
    advice = F.when(F.col("gone"), F.lit(ADVICE["gone"]))
    for kind, text in ADVICE.items():
        advice = advice.when(F.col("kind") == kind, F.lit(text))
    by_edge = hit.groupBy("node_id", "entry").agg(F.count(F.lit(1)).alias("changed_edges"), F.array_sort(F.collect_set(advice)).alias("advice"))  # of a handful of texts
    every = refs.select("node_id", "entry").distinct().join(by_node, ["node_id", "entry"], "left").join(by_edge, ["node_id", "entry"], "left").na.fill(0, ["changed_nodes", "changed_edges"])
    every = stored(every.withColumn("direct", (F.col("changed_nodes") > 0) | (F.col("changed_edges") > 0)))
    gaps = affected(every.where("direct and node_id like 'gap:%'").select(F.col("node_id").alias("node")), refs.where("node_id like 'gap:%' and ref like 'gap:%'").select(F.col("node_id").alias("node"), F.col("ref").alias("on")))
    reached = refs.join(gaps.select(F.col("node").alias("ref")), "ref", "left_semi").select("node_id", "entry").distinct().withColumn("by_gap", F.lit(True))
    said = F.when(F.size("advice") > 0, F.array_join("advice", "; "))
    text = F.when(F.col("direct"), F.coalesce(said, F.lit(ANY_CHANGE))).when(F.col("by_gap"), F.lit(BY_GAP)).otherwise(F.lit(NO_CHANGE))
    out = every.join(reached, ["node_id", "entry"], "left")
    return out.select("node_id", "entry", "changed_nodes", "changed_edges", (F.col("direct") | F.coalesce("by_gap", F.lit(False))).alias("affected"), text.alias("suggestions"))


def merge_updates(previous: DataFrame, changes: DataFrame) -> DataFrame:
    """``node_id, entry, n_events, n_reviewed, status``: stored judgments with one more round of changes.

    A change that does not affect a judgment leaves what is stored; one that does adds an event and reopens
    it.  ``previous`` has the columns of the result, ``changes`` ``node_id, entry, affected``.
    """
    old = previous.select("node_id", "entry", "n_events", "n_reviewed", F.col("status").alias("old_status"))
    both = old.join(changes.select("node_id", "entry", "affected"), ["node_id", "entry"], "full_outer")
    hit = F.coalesce("affected", F.lit(False))
    events = F.coalesce("n_events", F.lit(0).cast("long")) + hit.cast("long")
    status = F.when(hit, "pending").otherwise(F.coalesce("old_status", F.lit("unchanged")))
    return both.select("node_id", "entry", events.alias("n_events"), F.coalesce("n_reviewed", F.lit(0).cast("long")).alias("n_reviewed"), status.alias("status"))


def resolve_updates(updates: DataFrame, reviews: DataFrame) -> DataFrame:
    """``updates`` after ``reviews`` (``node_id, entry, decision, note``), with ``outcome`` of each row.

    A review covers the events so far and resolves a pending judgment; one of an unknown decision, or without a
    note, or of what is not pending, is refused.  Rows that none concerns have no outcome; of several reviews of one row
    the first valid one counts, as what it resolves is not pending for the next.
    """
    good = F.coalesce(F.col("decision").isin(*DECISIONS) & (F.trim("note") != ""), F.lit(False))
    told = reviews.groupBy("node_id", "entry").agg(F.max(good).alias("good"))
    both = updates.join(told, ["node_id", "entry"], "left")
    outcome = F.when(F.col("good").isNull(), F.lit(None).cast("string")).when(~F.col("good"), "invalid_review").when(F.col("status") != "pending", "not_pending").otherwise("resolved")
    done = F.coalesce(outcome == "resolved", F.lit(False))
    return both.select("node_id", "entry", "n_events", F.when(done, F.col("n_events")).otherwise(F.col("n_reviewed")).alias("n_reviewed"), F.when(done, "resolved").otherwise(F.col("status")).alias("status"), outcome.alias("outcome"))


#: What an entry of the log of judgments holds, beside the ``node_id, entry`` that it concerns.
LOG = "seq long, affected boolean, suggestions array<string>, decision string, note string"


def _is_review() -> Column:
    return F.coalesce(F.col("decision").isin(*DECISIONS) & (F.trim("note") != ""), F.lit(False))


def reviewed_log(log: DataFrame) -> DataFrame:
    """``node_id, entry, n_events, n_reviewed, status, suggestions`` of every judgment after its whole log (``LOG``).

    A row of the log is a change (without a decision) or a review.  A change that affects the judgment is an event; a
    valid review covers the events before it.  ``suggestions`` are those of the events that no review covers.
    """
    order = Window.partitionBy("node_id", "entry").orderBy("seq")
    event = F.col("decision").isNull() & F.coalesce("affected", F.lit(False))
    counted = log.where(F.col("decision").isNull() | _is_review()).withColumn("event", event).withColumn("n", F.sum(F.col("event").cast("long")).over(order))
    state = counted.groupBy("node_id", "entry").agg(
        F.max("n").alias("n_events"), F.coalesce(F.max(F.when(F.col("decision").isNotNull(), F.col("n"))), F.lit(0).cast("long")).alias("n_reviewed"), F.max(F.col("decision").isNull()).alias("told")
    )
    said = counted.where("event").join(state.select("node_id", "entry", "n_reviewed"), ["node_id", "entry"]).where("n > n_reviewed").select("node_id", "entry", F.explode("suggestions").alias("s"))
    said = said.groupBy("node_id", "entry").agg(F.array_join(F.array_sort(F.collect_set("s")), "; ").alias("suggestions"))  # of a handful of texts
    status = F.when(F.col("n_events") == 0, "unchanged").when(F.col("n_reviewed") < F.col("n_events"), "pending").otherwise("resolved")
    out = state.where("told").join(said, ["node_id", "entry"], "left")  # reviews of what no change ever named are refused
    return out.select("node_id", "entry", "n_events", "n_reviewed", status.alias("status"), F.coalesce("suggestions", F.lit("")).alias("suggestions"))


def open_suggestions(events: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``node_id, entry, suggestions``: distinct suggestions of the events (``node_id, entry, place, suggestion``) after those already reviewed (``node_id, entry, n_reviewed``)."""
    fresh = events.join(reviewed, ["node_id", "entry"], "left").where(F.col("place") > F.coalesce("n_reviewed", F.lit(0)))
    return fresh.groupBy("node_id", "entry").agg(F.array_join(F.array_sort(F.collect_set("suggestion")), "; ").alias("suggestions"))  # of a handful of texts


def pending_for(updates: DataFrame, dependencies: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pending ``updates`` of a chosen node (``node``), or of a judgment that depends on one."""
    by_ref = dependencies.join(F.broadcast(chosen.select(F.col("node").alias("ref"))), "ref", "left_semi").select("node_id", "entry")
    by_node = updates.join(F.broadcast(chosen.select(F.col("node").alias("node_id"))), "node_id", "left_semi").select("node_id", "entry")
    return updates.where("status = 'pending'").join(by_ref.union(by_node).distinct(), ["node_id", "entry"], "left_semi")


def project_impacts(declared: DataFrame, touched_nodes: DataFrame) -> DataFrame:
    """``project, part, n_refs, n_touched`` of each part of a project (``project, part, ref``) that declares something touched (``node``)."""
    hit = declared.join(touched_nodes.select(F.col("node").alias("ref"), F.lit(1).alias("hit")), "ref", "left")
    counted = hit.groupBy("project", "part").agg(F.count_distinct("ref").alias("n_refs"), F.count_distinct(F.when(F.col("hit") == 1, F.col("ref"))).alias("n_touched"))
    return counted.where("n_touched > 0")


def latest_briefs(briefs: DataFrame, most: int = 3) -> DataFrame:
    """The newest ``most`` of the latest brief of each topic and view (``id, topic, view, date``); a brief without a topic is its own."""
    scoped = briefs.withColumn("_scope", F.coalesce("topic", "id"))
    order = Window.partitionBy("_scope", F.coalesce("view", F.lit(""))).orderBy(F.desc("date"), F.desc("id"))
    newest = scoped.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_scope")
    return newest.orderBy(F.desc("date"), F.desc("id")).limit(most)


def reserve_first(pools: DataFrame, cap: int = 15) -> DataFrame:
    """``node, place``: the first of each pool (``pool, at, node``, ``at`` unique within a pool) before all others, then pools in turn, each node once, ``cap`` in all."""
    return round_robin(pools, "pool", "at", "node", max(1, cap)).select("node", F.col("turn").cast("int").alias("place"))
