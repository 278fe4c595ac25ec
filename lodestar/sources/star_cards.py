"""A vault of Markdown cards written from the star tables, one row a card: what the card reader is tried on at any size.

Customers are papers whose claims are their orders, suppliers gaps, dear orders transfers, and customers with small
orders have briefs.  Some cards hold what a reader must report: lines without a key, tags that name nothing, claims
without an anchor, retractions of no claim, repeated relations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources.star import LARGE, MOST, SMALL, Star


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def filled(form: str, **values: Column | str) -> Column:
    """``form`` with ``{name}`` replaced by columns."""
    parts, rest = [], form
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), _s(values.get(name, name))]
    return F.concat(*parts, F.lit(rest))


def _lines(*lines: Column | str | None) -> Column:
    """Lines below each other; null ones are left out."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _joined(own: str, sep: str = "\n") -> Column:
    """The texts ``line`` of a group in order of ``at``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), sep).alias(own)


def _table(section: str, header: str, rows: str) -> Column:
    return F.when(F.col(rows).isNotNull(), F.concat(F.lit(f"\n## {section}\n{header}\n|{'---|' * header.count(' | ')}---|\n"), F.col(rows)))


def papers(star: Star) -> DataFrame:
    """``path, text``."""
    t = star.table
    place = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "n_nationkey", "n_regionkey")
    o = F.col("o_orderkey")
    orders = t("orders").join(place.select(F.col("c_custkey").alias("o_custkey"), "n_nationkey"), "o_custkey")
    quote = F.when(o % 19 == 0, filled("{o_orderpriority} — twice")).otherwise(filled("{o_orderpriority} order"))
    claim = F.concat(filled("- C{o_orderkey} [nation-{n_nationkey}]: "), quote, F.when(o % 2 == 0, "\n  of weight").otherwise(""), F.when(o % 17 == 0, "").otherwise(filled(" — order {o_orderkey}")))
    back = F.when(F.col("o_orderstatus") == "F", filled("\n- Retraction of C{o_orderkey} (2024-01-02): closed"))
    claims = orders.select("o_custkey", o.alias("at"), F.concat(claim, F.coalesce(back, F.lit(""))).alias("line")).groupBy("o_custkey").agg(_joined("claims"), F.min("at").alias("first"))
    kind = F.when(F.col("l_returnflag") == "R", "disputes").when(F.col("l_returnflag") == "A", "supports").otherwise("partially_addresses")
    sold = t("lineitem").where(F.col("l_quantity") >= MOST).join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    relation = filled("| C{o_orderkey} | {kind} | gap:supplier-{l_suppkey} | author | direct_response | all | because |", kind=kind)
    relation = F.when(F.col("l_orderkey") % 10 == 0, F.concat(relation, F.lit("\n"), relation)).otherwise(relation)
    relations = sold.select("o_custkey", F.struct("l_orderkey", "l_linenumber").alias("at"), relation.alias("line")).groupBy("o_custkey").agg(_joined("relations"))
    k = F.col("c_custkey")
    own = place.join(claims.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").join(relations.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    text = _lines(
        "---", filled("slug: customer-{c_custkey}"), filled('title: "{c_name} of {n_name}"'), filled("year: {y}", y=1990 + k % 30), filled('source: "see https://doi.org/10.5555/C.{c_custkey}."'),
        filled("domain: [region-{n_regionkey}]"), filled("task: [nation-{n_nationkey}]"), F.when(k % 5 == 0, filled("pattern: [brand-{b}, lost]", b=1 + k % 25)), F.when(k % 11 == 0, "no key here"),
        F.when(k % 13 == 0, filled("gaps: [supplier-{s}:supports, bad]", s=1 + k % 7)), "---", filled("# {c_name}"), "", "## Claims", F.col("claims"),
        F.when(k % 23 == 0, "- Retraction of C0 (2024-01-02): none"), F.when(F.col("first").isNotNull(), filled("\n## Study profile\n- method: C{first}")), F.when(k % 29 == 0, "\n## Study profile\nnot a role"),
        _table("Evidence relations", "| Claim | Relation | Target | Attribution | Comparison | Scope | Rationale |", "relations"), "",
    )
    return own.select(filled("papers/customer-{c_custkey}.md").alias("path"), text.alias("text"))


def gaps(star: Star) -> DataFrame:
    t = star.table
    sold = t("lineitem").where(F.col("l_quantity") >= MOST).join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rests = sold.select("l_suppkey", F.col("o_orderkey").alias("at"), filled("claim:customer-{o_custkey}#C{o_orderkey}").alias("line")).distinct().groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(_joined("refs", ", "))
    row = filled("| S1 | it stands | {refs} | - | so it is |")
    own = t("supplier").join(rests, "s_suppkey", "left").withColumn("rows", F.when(F.col("refs").isNotNull(), row))
    text = _lines("---", "type: open", "status: live", filled("concepts: [nation-{s_nationkey}, nowhere]"), filled("related: [supplier-{n}]", n=F.col("s_suppkey") + 1), "---", filled("About {s_name}"), _table("Synthesis", "| ID | Statement | Claims | Gaps | Rationale |", "rows"), "")
    return own.select(filled("gaps/supplier-{s_suppkey}.md").alias("path"), text.alias("text"))


def transfers(star: Star) -> DataFrame:
    t = star.table
    large = t("orders").where(F.col("o_totalprice") >= LARGE).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    seller = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("s_suppkey"), F.min("l_partkey").alias("p_partkey"))
    own = large.join(seller, "o_orderkey").join(t("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(t("part").select("p_partkey", F.substring_index("p_brand", "#", -1).alias("brand")), "p_partkey")
    text = _lines("---", filled("a: nation-{c_nationkey}"), filled("c: nation-{s_nationkey}"), filled("bridges: [brand-{brand}]"), filled("papers: [customer-{o_custkey}]"), filled("gaps: [supplier-{s_suppkey}]"), "status: idea", "---", "")
    return own.select(filled("transfers/order-{o_orderkey}.md").alias("path"), text.alias("text"))


def briefs(star: Star) -> DataFrame:
    t = star.table
    small = t("orders").where(F.col("o_totalprice") < SMALL).select("o_custkey", F.substring("o_orderpriority", 1, 1).alias("p"), F.col("o_orderkey").alias("at"), filled("claim:customer-{o_custkey}#C{o_orderkey}").alias("line"))
    rows = small.groupBy("o_custkey", "p").agg(_joined("refs", ", ")).select("o_custkey", F.col("p").alias("at"), filled("| B{p} | it stands | {refs} | - | so it is |").alias("line"))
    own = rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(_joined("rows")).join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    text = _lines("---", filled("topic: nation-{c_nationkey}"), filled("view: {c_mktsegment}"), "---", _table("Synthesis", "| ID | Statement | Claims | Gaps | Rationale |", "rows"), "")
    return own.select(filled("briefs/2024-01-0{d}-customer-{c_custkey}.md", d=1 + F.col("c_custkey") % 9).alias("path"), text.alias("text"))


def registries(star: Star) -> DataFrame:
    """Both registries; nations and brands are a handful."""
    t = star.table
    tasks = t("nation").select(F.lit(0).alias("part"), filled("| nation-{n_nationkey} | region-{n_regionkey} | canonical | {n} |", n=F.lower("n_name")).alias("line"), F.col("n_nationkey").cast("int").alias("at"))
    brands = t("part").select(F.lit(1).alias("part"), F.substring_index("p_brand", "#", -1).cast("int").alias("at")).distinct().select("part", filled("| brand-{at} | - | canonical |").alias("line"), "at")
    both = tasks.union(brands).groupBy("part").agg(_joined("rows"))
    concepts = both.agg(F.max(F.when(F.col("part") == 0, F.col("rows"))).alias("tasks"), F.max(F.when(F.col("part") == 1, F.col("rows"))).alias("brands"))
    domains = t("region").select(F.col("r_regionkey").alias("at"), filled("| region-{r_regionkey} | {r_name} | live |").alias("line")).agg(_joined("rows"))
    return concepts.select(F.lit("concepts.md").alias("path"), _lines("# Concepts", "", "## task", F.col("tasks"), "", "## pattern", F.col("brands"), "").alias("text")).union(
        domains.select(F.lit("domains.md"), _lines("# Domains", "", F.col("rows"), ""))
    )


def cards(star: Star) -> DataFrame:
    """``path, text`` of the whole vault."""
    return reduce(DataFrame.union, [papers(star), gaps(star), transfers(star), briefs(star), registries(star)])
