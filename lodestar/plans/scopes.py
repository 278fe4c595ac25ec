"""Queries of scopes, sets and lookups over the star tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as words
from lodestar.operators import graph, impact, scopes
from lodestar.plans.catalog import PARENTS
from lodestar.plans.records import RECEIPTS, _receipts
from lodestar.plans.registry import query
from lodestar.plans.retrieval import CLAIM, EVIDENCE
from lodestar.sources.star import Star
from lodestar.sources.stored import stored


def _text(c: str) -> Column:
    return F.col(c).cast("string")


@query("SELECT 'customer-' || c_custkey AS slug FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR c_mktsegment = 'ASIA'")
def s32_scope_cards(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    placed = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cards = placed.select(F.concat(F.lit("customer-"), _text("c_custkey")).alias("slug"), F.array("r_name", "c_mktsegment").alias("domains"))
    return scopes.in_scope(cards, "domain:ASIA").select("slug")


@query(f"WITH {PARENTS} SELECT parent, child, (row_number() OVER (PARTITION BY parent ORDER BY child))::INTEGER AS place FROM (SELECT DISTINCT * FROM parents)")
def a11_children(spark: SparkSession, d: str) -> DataFrame:
    return scopes.children(Star(spark, d).parents())


@query("SELECT l_partkey AS ref, CASE WHEN p_size > 10 THEN p_name END AS slug, CASE WHEN p_size > 10 THEN 'work' ELSE 'project-source' END AS kind FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48")
def j11_resolved_references(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    return scopes.resolved(t("lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("ref")), t("part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("slug")))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def w11_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return scopes.keep_first(Star(spark, d).table("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(f"""WITH w AS (SELECT 'work:customer-' || c_custkey AS work, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY place LIMIT 15),
c AS (SELECT {CLAIM} AS claim, place FROM orders JOIN w ON work = 'work:customer-' || o_custkey WHERE o_orderstatus <> 'F')
SELECT claim, place::INTEGER AS place, (SELECT count(*) FROM c) AS total FROM c ORDER BY place, claim LIMIT 30""")
def j20_drilled_claims(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    best = star.table("customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(15)
    place = F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey"))  # over 15 rows
    works = best.select(F.concat(F.lit("work:customer-"), _text("c_custkey")).alias("work"), place.alias("place"))
    return scopes.drilled(works, star.evidence_edges())


@query("SELECT l_orderkey || '-' || l_linenumber AS observation, CASE WHEN s_suppkey IS NULL THEN 'judgment' ELSE 'material' END AS problem FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 2) ON l_partkey = p_partkey WHERE s_suppkey IS NULL OR p_partkey IS NULL")
def j26_misplaced_observations(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    seen = t("lineitem").select(F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias("observation"), F.col("l_suppkey").alias("judgment"), F.col("l_partkey").alias("material"))
    return scopes.misplaced_observations(seen, t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("judgment")), t("part").where("p_size > 2").select(F.col("p_partkey").alias("material")))


@query("""WITH q AS (SELECT DISTINCT lower(p_brand) AS venue, p_type AS category, 'Q' || (1 + (length(p_brand) + length(p_type)) % 4) AS quartile FROM part WHERE p_brand NOT IN ('Brand#3', 'Brand#7')),
m AS (SELECT venue, array_to_string(list_sort(list(category || '=' || quartile)), '; ') AS quartiles FROM q GROUP BY venue) SELECT p_partkey AS work, p_brand AS venue, coalesce(quartiles, '') AS quartiles FROM part LEFT JOIN m ON m.venue = lower(p_brand)""")
def j27_venue_quartiles(spark: SparkSession, d: str) -> DataFrame:
    """Each work with the quartiles of its venue, by category; two venues have none."""
    part = Star(spark, d).table("part")
    quartile = F.concat(F.lit("Q"), (1 + (F.length("p_brand") + F.length("p_type")) % 4).cast("string"))
    known = part.where(~F.col("p_brand").isin("Brand#3", "Brand#7")).select(F.lower("p_brand").alias("venue"), F.col("p_type").alias("category"), quartile.alias("quartile")).distinct()
    told = impact.with_quartiles(part.select(F.col("p_partkey").alias("work"), F.col("p_brand").alias("venue")), known)
    return told.select("work", "venue", F.array_join(F.array_sort(F.transform(F.map_entries("quartiles"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "; ").alias("quartiles"))


@query("SELECT c_custkey, citations::VARCHAR AS citations FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS citations FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 4 > 0 GROUP BY 1) USING (c_custkey)")
def j28_cards_with_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Every card, those without a snapshot too."""
    t = Star(spark, d).table
    counts = t("orders").where("o_orderstatus = 'O' and o_custkey % 4 > 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("citations"))
    return t("customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", _text("citations").alias("citations"))


@query(f"WITH RECURSIVE {EVIDENCE} SELECT DISTINCT l_returnflag AS \"group\", domain FROM lineitem JOIN closure ON node = 'gap:supplier-' || l_suppkey")
def a10_domains_of_groups(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    groups = star.table("lineitem").select(F.col("l_returnflag").alias("group"), F.concat(F.lit("gap:supplier-"), _text("l_suppkey")).alias("node")).distinct()
    return scopes.domains_of(groups, stored(graph.domain_closure(star.parents())))


@query("SELECT DISTINCT split_part(p_brand, '#', 2)::INTEGER AS root FROM part EXCEPT SELECT n_nationkey FROM nation")
def u4_unregistered_roots(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    roots = t("part").select(F.substring_index("p_brand", "#", -1).cast("int").alias("root")).distinct()
    return roots.join(t("nation").select(F.col("n_nationkey").alias("root")), "root", "left_anti")


@query("SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'A') AS chosen FROM supplier")
def u5_chosen_gaps(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    return scopes.split_by(t("supplier"), t("lineitem").where("l_quantity = 50 and l_returnflag = 'A'").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def u2_matched_ids(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    return t("orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").union(t("customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT DISTINCT 'gap:supplier-' || l_suppkey AS endpoint FROM lineitem WHERE l_quantity > 49 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000)")
def u6_endpoints_outside(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    name = lambda c: F.concat(F.lit("gap:supplier-"), _text(c)).alias("endpoint")
    return t("lineitem").where("l_quantity > 49").select(name("l_suppkey")).distinct().join(t("supplier").where("s_acctbal > 3000").select(name("s_suppkey")), "endpoint", "left_anti")


@query(f"WITH {RECEIPTS} SELECT request, CASE WHEN quarantined OR identity_status = 'mismatch' THEN 'quarantined' WHEN acquisition_status <> 'acquired' THEN 'not_acquired' WHEN identity_status <> 'verified' THEN 'unverified' WHEN text_status <> 'ready' THEN 'no_text' ELSE 'eligible' END AS state FROM receipts")
def t4_receipt_state(spark: SparkSession, d: str) -> DataFrame:
    return scopes.receipt_state(_receipts(spark, d))


@query("SELECT page_id, lower(regexp_replace('https://DOI.org/' || url, '^https?://(dx\\.)?doi\\.org/', '', 'i')) AS doi FROM pages".replace("\\.", r"\."))
def c5_clean_doi(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).table("pages").select("page_id", words.clean_doi(F.concat(F.lit("https://DOI.org/"), "url")).alias("doi"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def c3_sha256(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).table("documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"SELECT {CLAIM} AS id, substr('C' || o_orderkey || ': ' || text, 1, 80) AS label FROM orders JOIN documents ON doc_id = o_orderkey")
def c15_claim_labels(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    both = t("orders").join(t("documents"), F.col("doc_id") == F.col("o_orderkey"))
    claim = F.concat(F.lit("claim:customer-"), _text("o_custkey"), F.lit("#C"), _text("o_orderkey"))
    return both.select(claim.alias("id"), F.substring(F.concat(F.lit("C"), _text("o_orderkey"), F.lit(": "), "text"), 1, 80).alias("label"))
