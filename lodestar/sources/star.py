"""A graph of evidence seen in relational tables: ``nodes``, ``parents`` and ``edges``.

Regions are domains, nations task concepts, parts and brands pattern and function concepts, customers
works, suppliers gaps, orders claims of their customer and transfers between what they join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line items of at least this quantity tie a customer or supplier to a part.
MANY = 45
#: Orders of at least this price are transfers between nations; those under the other are what briefs rest on.
LARGE, SMALL = 490_000, 20_000
#: Line items of at least this quantity are what judgments on gaps rest on.
MOST = 50
AXES = ("pattern", "function", "failure-mode")


def _id(kind: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(kind), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


class Star:
    """Lazy frames over the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def nodes(self) -> DataFrame:
        """``id, kind, label``."""
        t = self.table
        return reduce(DataFrame.union, [
            t("region").select(_id("domain:", "r_name").alias("id"), F.lit("domain").alias("kind"), F.col("r_name").alias("label")),
            t("nation").select(_id("concept:", "n_name"), F.lit("concept"), F.col("n_name")),
            t("customer").select(_id("work:customer-", "c_custkey"), F.lit("work"), F.col("c_name")),
            t("supplier").select(_id("gap:supplier-", "s_suppkey"), F.lit("gap"), F.col("s_name")),
            t("part").select(_id("concept:part-", "p_partkey"), F.lit("concept"), F.col("p_name")),
            t("part").select(_id("concept:", "p_brand"), F.lit("concept"), F.col("p_brand")).distinct(),
        ])

    def parents(self) -> DataFrame:
        """``child, parent``; works and gaps under their nation, nations under their region."""
        t = self.table
        nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
        return reduce(DataFrame.union, [
            nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(_id("concept:", "n_name").alias("child"), _id("domain:", "r_name").alias("parent")),
            t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(_id("work:customer-", "c_custkey"), _id("concept:", "n_name")),
            t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(_id("gap:supplier-", "s_suppkey"), _id("concept:", "n_name")),
        ])

    def order_parents(self) -> DataFrame:
        """``child, parent`` of orders as transfers: the nations of their customer and of their suppliers, so with diamonds."""
        t = self.table
        nation = t("nation").select("n_nationkey", "n_name")
        buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("k"))
        sellers = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("s_nationkey").alias("k"))
        both = buyers.union(sellers).distinct().join(nation, F.col("k") == F.col("n_nationkey"))
        return both.select(_id("transfer:order-", "o_orderkey").alias("child"), _id("concept:", "n_name").alias("parent"))

    def edges(self) -> DataFrame:
        """``kind, src, dst``, each once: claims, retracted claims, tags by part, concerns."""
        t = self.table
        many = t("lineitem").where(F.col("l_quantity") >= MANY).select("l_orderkey", "l_partkey", "l_suppkey")
        claims = t("orders").select(
            F.when(F.col("o_orderstatus") == "F", "retracted_claims").otherwise("claims").alias("kind"),
            _id("work:customer-", "o_custkey").alias("src"),
            F.concat(_id("claim:customer-", "o_custkey"), F.lit("#C"), F.col("o_orderkey").cast("string")).alias("dst"),
        )
        tags = many.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return reduce(DataFrame.union, [
            claims,
            tags.select(F.lit("tag:pattern"), _id("work:customer-", "o_custkey"), _id("concept:part-", "l_partkey")).distinct(),
            many.select(F.lit("concerns"), _id("gap:supplier-", "l_suppkey"), _id("concept:part-", "l_partkey")).distinct(),
        ])

    def axis(self) -> Column:
        """The axis of a part as a concept, by its size."""
        return F.element_at(F.array(*map(F.lit, AXES)), (F.col("p_size") % 3 + 1).cast("int"))

    def evidence_nodes(self) -> DataFrame:
        """``id, kind, label, axis, text`` of domains, concepts, works, gaps, claims and transfers; ``text`` is what a search looks at."""
        t, none = self.table, F.lit(None).cast("string")
        large = t("orders").where(F.col("o_totalprice") >= LARGE)
        nodes = reduce(DataFrame.union, [
            t("region").select(_id("domain:", "r_name").alias("id"), F.lit("domain").alias("kind"), F.col("r_name").alias("label"), none.alias("axis")),
            t("nation").select(_id("concept:", "n_name"), F.lit("concept"), F.col("n_name"), F.lit("task")),
            t("part").select(_id("concept:part-", "p_partkey"), F.lit("concept"), F.col("p_name"), self.axis()),
            t("customer").select(_id("work:customer-", "c_custkey"), F.lit("work"), F.concat_ws(" ", "c_name", "c_mktsegment"), none),
            t("supplier").select(_id("gap:supplier-", "s_suppkey"), F.lit("gap"), F.col("s_name"), none),
            t("orders").select(self._claim(), F.lit("claim"), F.concat(F.lit("C"), F.col("o_orderkey").cast("string"), F.lit(": "), F.col("o_orderpriority")), none),
            large.select(_id("transfer:order-", "o_orderkey"), F.lit("transfer"), _id("order ", "o_orderkey"), none),
        ])
        return nodes.withColumn("text", F.lower(F.concat_ws(" ", "label", "id", "axis")))

    def _claim(self) -> Column:
        return F.concat(_id("claim:customer-", "o_custkey"), F.lit("#C"), F.col("o_orderkey").cast("string"))

    def evidence_parents(self) -> DataFrame:
        """``child, parent``, with each claim under its work."""
        return self.parents().union(self.table("orders").select(self._claim(), _id("work:customer-", "o_custkey")))

    def evidence_edges(self) -> DataFrame:
        """``kind, src, dst``, each once: claims, tags by the part's axis, concerns, what claims bind, and ends of transfers."""
        t = self.table
        many = t("lineitem").where(F.col("l_quantity") >= MANY).select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
        sold = many.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        tagged = sold.join(t("part").select("p_partkey", self.axis().alias("axis")), F.col("l_partkey") == F.col("p_partkey"))
        nation = t("nation").select("n_nationkey", _id("concept:", "n_name").alias("place"))
        large = t("orders").where(F.col("o_totalprice") >= LARGE)
        buyers = large.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        sellers = t("lineitem").select("l_orderkey", "l_suppkey").join(large, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        sellers = sellers.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        kind = F.when(F.col("o_orderstatus") == "F", "retracted_claims").otherwise("claims")
        return reduce(DataFrame.union, [
            t("orders").select(kind.alias("kind"), _id("work:customer-", "o_custkey").alias("src"), self._claim().alias("dst")),
            tagged.select(F.concat(F.lit("tag:"), F.col("axis")), _id("work:customer-", "o_custkey"), _id("concept:part-", "l_partkey")).distinct(),
            many.select(F.lit("concerns"), _id("gap:supplier-", "l_suppkey"), _id("concept:part-", "l_partkey")).distinct(),
            sold.where("l_returnflag = 'A'").select(F.lit("binds"), self._claim(), _id("concept:part-", "l_partkey")).distinct(),
            buyers.select(F.lit("transfer-from"), _id("transfer:order-", "o_orderkey"), F.col("place")).distinct(),
            sellers.select(F.lit("transfer-to"), _id("transfer:order-", "o_orderkey"), F.col("place")).distinct(),
        ])

    def relations(self) -> DataFrame:
        """``kind, src, dst``, each once: how claims bear on the gaps of the suppliers of their order."""
        t = self.table
        kind = F.when(F.col("l_returnflag") == "R", "disputes").when(F.col("l_returnflag") == "A", "supports").otherwise("partially_addresses")
        sold = t("lineitem").where(F.col("l_quantity") >= MANY).join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return sold.select(kind.alias("kind"), self._claim().alias("src"), _id("gap:supplier-", "l_suppkey").alias("dst")).distinct()

    def briefs(self) -> DataFrame:
        """``id, topic, view, date, label``: one brief for each customer with small orders, on its nation, seen by its segment."""
        t = self.table
        last = t("orders").where(F.col("o_totalprice") < SMALL).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
        own = last.join(t("customer"), "c_custkey").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return own.select(_id("brief:customer-", "c_custkey").alias("id"), F.col("n_name").alias("topic"), F.col("c_mktsegment").alias("view"), F.date_format("last", "yyyy-MM-dd").alias("date"), _id("brief of ", "c_name").alias("label"))

    def synthesis(self) -> DataFrame:
        """``node, place, entry, ref``, each once: briefs rest on small orders by priority and on gaps of much that these bought, gaps on orders that bought most."""
        t = self.table
        first = F.substring("o_orderpriority", 1, 1)
        small = t("orders").where(F.col("o_totalprice") < SMALL).select("o_orderkey", "o_custkey", first.cast("int").alias("place"), F.concat(F.lit("B"), first).alias("entry"))
        bought = t("lineitem").where(F.col("l_quantity") >= MANY).select("l_orderkey", "l_suppkey", "l_quantity")
        of_brief = _id("brief:customer-", "o_custkey").alias("node")
        most = bought.where(F.col("l_quantity") >= MOST).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return reduce(DataFrame.union, [
            small.select(of_brief, "place", "entry", self._claim().alias("ref")),
            small.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select(of_brief, "place", "entry", _id("gap:supplier-", "l_suppkey")),
            most.select(_id("gap:supplier-", "l_suppkey"), F.lit(1), F.lit("S1"), self._claim()),
        ]).distinct()

    def research_nodes(self) -> DataFrame:
        """``evidence_nodes`` and briefs."""
        briefs = self.briefs().select("id", F.lit("brief").alias("kind"), "label", F.lit(None).cast("string").alias("axis"))
        return self.evidence_nodes().union(briefs.withColumn("text", F.lower(F.concat_ws(" ", "label", "id"))))
