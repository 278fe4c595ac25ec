"""Hierarchy and corridor operators over ``nodes``, ``parents`` and ``edges``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.stored import stored

MAX_PAGE = 500
#: Links between nodes that have children up to which one task closes them.
AT_ONCE = 100_000
#: Nodes of one neighbour whose pairs one task makes.
HOT = 2000


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of node and ancestor of the links of one task."""
    above: dict[str, set[str]] = {}
    for batch in batches:
        for child, parent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            above.setdefault(child, set()).add(parent)
    for node in above:
        found, fresh = set(), {node}
        while fresh := {p for n in fresh for p in above.get(n, ())} - found:
            found |= fresh
        yield pa.RecordBatch.from_arrays([pa.array([node] * len(found)), pa.array(sorted(found))], ["node", "ancestor"])


def ancestors(parents: DataFrame, start: DataFrame | None = None, prefix: str = "", at_once: int = AT_ONCE) -> DataFrame:
    """``node, ancestor`` of the parents' DAG, each pair once; of ``start`` nodes only, and of ancestors with ``prefix`` only, if given.

    Only links of nodes that have children are closed, which are few beside the leaves; the rest is one join with
    that closure.  Up to ``at_once`` such links are closed in one task; more of them level by level, a level being the
    pairs that are new.  Either way a cycle ends by itself and no depth is too deep.
    """
    links = parents.select("child", "parent")
    inner = stored(links.join(links.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").where("parent is not null").distinct())
    if inner.count() <= at_once:
        found = inner.coalesce(1).mapInArrow(_close, "node string, ancestor string")
    else:
        found = fresh = inner.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
        while not fresh.isEmpty():
            further = fresh.join(inner.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("node", F.col("parent").alias("ancestor")).distinct()
            fresh = stored(further.join(found, ["node", "ancestor"], "left_anti"))
            found = found.union(fresh)
    own = links if start is None else links.join(start.select(F.col("node").alias("child")), "child", "left_semi")
    wanted = F.startswith("ancestor", F.lit(prefix))
    above = own.join(found.where(wanted).withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), "ancestor")
    return own.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where(wanted).union(above).distinct()


def domain_closure(parents: DataFrame) -> DataFrame:
    """``node, domain``: every domain above a node, and a domain itself."""
    up = ancestors(parents, prefix="domain:").withColumnRenamed("ancestor", "domain")
    own = parents.where(F.startswith("parent", F.lit("domain:"))).select(F.col("parent").alias("node"), F.col("parent").alias("domain"))
    return up.union(own).distinct()


def sides(attached: DataFrame, closure: DataFrame, sample: int = 3) -> DataFrame:
    """``concept, domain, n, first``: how many nodes of a domain attach to a concept, and an array of the first ``sample`` of them.

    ``attached`` has ``node, concept``.  Nodes are counted with partial sums, and only ``sample`` of them from each task are
    ever ranked, so a concept that holds a third of all rows is not gathered anywhere.
    """
    own = stored(attached.select("node", "concept").distinct().join(closure, "node"))
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("concept", "domain").orderBy("node"))).where(F.col("r") <= sample)
    first = ranked.groupBy("concept", "domain").agg(F.array_sort(F.collect_list("node")).alias("first"))  # ``sample`` nodes at most
    return own.groupBy("concept", "domain").agg(F.count(F.lit(1)).alias("n")).join(first, ["concept", "domain"])


def shared_concepts(edges: DataFrame, closure: DataFrame, sample: int = 3) -> DataFrame:
    """``a, c, concept, n_a, n_c, first_a``: concepts that nodes of two domains attach to, with counts and a sample of side a, an array.

    Attachments are counted for each concept and domain before domains are paired, so the pairing sees
    one row for each concept and domain, however many nodes attach.
    """
    both = stored(sides(edges.select(F.col("src").alias("node"), F.col("dst").alias("concept")), closure, sample))
    left = both.select("concept", F.col("domain").alias("a"), F.col("n").alias("n_a"), F.col("first").alias("first_a"))
    right = both.select("concept", F.col("domain").alias("c"), F.col("n").alias("n_c"))
    return left.join(right, "concept").where("a < c").select("a", "c", "concept", "n_a", "n_c", "first_a")


def spanning(closure: DataFrame) -> DataFrame:
    """``a, c, n``: nodes whose domains hold both of a pair."""
    return closure.alias("x").join(closure.alias("y"), "node").where("x.domain < y.domain").groupBy(F.col("x.domain").alias("a"), F.col("y.domain").alias("c")).agg(F.count(F.lit(1)).alias("n"))


def page(items: DataFrame, cursor: str | None = None, limit: int = 50, key: str = "id") -> DataFrame:
    """The next ``limit`` (1 to 500) rows after ``cursor`` in order of ``key``; a cursor must be a key that exists."""
    if cursor is not None and items.where(F.col(key) == cursor).isEmpty():
        raise ValueError("bad_cursor")
    after = items if cursor is None else items.where(F.col(key) > cursor)
    return after.orderBy(key).limit(max(1, min(int(limit), MAX_PAGE)))


def level(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Nodes of a hierarchy level's kinds."""
    return nodes.where(F.col("kind").isin(kinds))


def siblings(parents: DataFrame) -> DataFrame:
    """``parent, n_children, n_sibling_pairs``, without pairing the children."""
    n = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    return n.select("parent", "n_children", (F.col("n_children") * (F.col("n_children") - 1)).alias("n_sibling_pairs"))


def context(node: str, parents: DataFrame, edges: DataFrame) -> DataFrame:
    """``relation, other`` around one node: parents, children, siblings, and ends of touching edges."""
    up = parents.where(F.col("child") == node).select(F.lit("parent").alias("relation"), F.col("parent").alias("other"))
    down = parents.where(F.col("parent") == node).select(F.lit("child"), F.col("child"))
    beside = parents.join(up.select(F.col("other").alias("parent")), "parent", "left_semi").where(F.col("child") != node).select(F.lit("sibling"), F.col("child")).distinct()
    out = edges.where(F.col("src") == node).select(F.concat(F.lit("out:"), F.col("kind")), F.col("dst"))
    into = edges.where(F.col("dst") == node).select(F.concat(F.lit("in:"), F.col("kind")), F.col("src"))
    return up.union(down).union(beside).union(out).union(into)


def similar_nodes(edges: DataFrame, least: int = 2, hot: int = HOT) -> DataFrame:
    """``a, b, n``: pairs of nodes that share ``least`` neighbours or more.

    Of ``least`` shared neighbours one is not among the ``least - 1`` commonest of either node, so these bring no pair
    together: a neighbour that nearly all nodes have costs nothing.  What pairs a neighbour of over ``hot`` nodes still
    brings are made by several tasks, and counted on both nodes' neighbours, each pair once.
    """
    own = stored(edges.select(F.col("src").alias("node"), F.col("dst").alias("via")).distinct())
    common = own.groupBy("via").agg(F.count(F.lit(1)).alias("m"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("m"), "via"))
    rare = stored(own.join(common, "via").withColumn("r", rank).where(F.col("r") >= least).select("node", "via", F.ceil(F.col("m") / hot).cast("int").alias("salts")))
    dealt = rare.select("node", "via", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"))
    told = rare.select(F.col("node").alias("other"), "via", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = dealt.join(told, ["via", "salt"]).where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    lists = stored(own.groupBy("node").agg(F.collect_list("via").alias("all")))  # one node's own neighbours
    both = pairs.join(lists.select(F.col("node").alias("a"), F.col("all").alias("x")), "a").join(lists.select(F.col("node").alias("b"), F.col("all").alias("y")), "b")
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("n")).where(F.col("n") >= least)


def unresolved(references: DataFrame, known: DataFrame, ref: str, key: str) -> DataFrame:
    """References that nothing known answers to."""
    return references.join(known.select(F.col(key).alias(ref)), ref, "left_anti")
