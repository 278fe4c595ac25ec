"""Queries of provider records, their cache and index snapshots; payloads are made from the star tables and read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.registry import query
from lodestar.plans.retrieval import EVIDENCE
from lodestar.sources import providers, snapshots
from lodestar.sources.star import Star
from lodestar.sources.stored import state_folder


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).table("orders").withColumn("k", _text("o_orderkey"))


def _openalex(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "repository").otherwise("journal")
    place = F.struct(F.struct(F.col("o_orderstatus").alias("display_name"), kind.alias("type")).alias("source"))
    share = F.when(F.col("o_custkey") % 3 == 0, F.struct((F.col("o_custkey") % 90).cast("double").alias("value")))
    named = F.struct(F.col("o_orderpriority").alias("display_name"))
    payload = F.to_json(F.struct(
        F.concat(F.lit("https://openalex.org/W"), "k").alias("id"), F.concat(F.lit("https://doi.org/10.1/AB"), "k").alias("doi"), F.col("o_orderpriority").alias("display_name"), F.year("o_orderdate").alias("publication_year"),
        F.col("o_custkey").alias("cited_by_count"), place.alias("primary_location"), share.alias("citation_normalized_percentile"), F.array(named, F.struct(F.lit(None).cast("string").alias("display_name"))).alias("topics"),
        F.array(F.concat(F.lit("https://openalex.org/W"), _text("o_custkey"))).alias("referenced_works"),
    ))
    return _orders(spark, d).select("o_orderkey", F.when(F.col("o_custkey") % 17 == 0, "not json").otherwise(payload).alias("payload"))


@query("""SELECT o_orderkey, CASE WHEN g THEN 'W' || o_orderkey END AS openalex, CASE WHEN g THEN '10.1/ab' || o_orderkey END AS doi, CASE WHEN g THEN o_orderpriority END AS title, CASE WHEN g THEN year(o_orderdate)::VARCHAR END AS year, CASE WHEN g THEN o_custkey::VARCHAR END AS citations,
  CASE WHEN g AND o_custkey % 3 = 0 THEN (CASE WHEN o_custkey % 90 <= 1 THEN (o_custkey % 90) * 100 ELSE o_custkey % 90 END)::INTEGER::VARCHAR END AS percentile, CASE WHEN g THEN o_orderpriority ELSE '' END AS categories, g AND o_orderstatus = 'P' AS preprint
FROM (SELECT *, o_custkey % 17 <> 0 AS g FROM orders)""")
def s22_openalex_records(spark: SparkSession, d: str) -> DataFrame:
    r = _openalex(spark, d).select("o_orderkey", providers.openalex(F.col("payload")).alias("r"))
    return r.select("o_orderkey", "r.openalex", "r.doi", "r.title", _text("r.year").alias("year"), _text("r.citations").alias("citations"), F.col("r.percentile").cast("int").cast("string").alias("percentile"), F.array_join("r.categories", ",").alias("categories"), F.coalesce("r.preprint", F.lit(False)).alias("preprint"))


@query("SELECT o_orderkey, 'W' || o_custkey AS openalex FROM orders WHERE o_custkey % 17 <> 0")
def s22_openalex_references(spark: SparkSession, d: str) -> DataFrame:
    return _openalex(spark, d).select("o_orderkey", F.explode(providers.references("openalex", F.col("payload"))).alias("x")).select("o_orderkey", "x.openalex")


def _crossref(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "posted-content").when(F.col("o_orderstatus") == "O", "journal-article").otherwise("book")
    message = F.struct(
        F.concat(F.lit("10.1/AB"), "k").alias("DOI"), F.array("o_orderpriority").alias("title"), F.array("o_orderstatus").alias("container-title"), kind.alias("type"), F.col("o_custkey").alias("is-referenced-by-count"),
        F.struct(F.array(F.array(F.year("o_orderdate"), F.month("o_orderdate"))).alias("date-parts")).alias("issued"), F.array(F.struct(F.concat(F.lit("10.1/R"), _text("o_custkey")).alias("DOI"), F.col("o_orderpriority").alias("unstructured"))).alias("reference"),
    )
    return _orders(spark, d).select("o_orderkey", F.to_json(F.struct(message.alias("message"))).alias("payload"))


@query("SELECT o_orderkey, '10.1/ab' || o_orderkey AS doi, o_orderpriority AS title, year(o_orderdate)::INTEGER AS year, o_orderstatus AS venue, o_custkey AS citations, o_orderstatus = 'P' AS preprint, o_orderstatus = 'O' AS reviewed, '10.1/r' || o_custkey AS cites FROM orders")
def s23_crossref_records(spark: SparkSession, d: str) -> DataFrame:
    rows = _crossref(spark, d).select("o_orderkey", providers.crossref(F.col("payload")).alias("r"), providers.references("crossref", F.col("payload"))[0]["doi"].alias("cites"))
    return rows.select("o_orderkey", "r.doi", "r.title", "r.year", "r.venue", "r.citations", F.coalesce("r.preprint", F.lit(False)).alias("preprint"), F.coalesce("r.reviewed", F.lit(False)).alias("reviewed"), "cites")


@query("SELECT o_orderkey, 's' || o_orderkey AS s2, '10.1/ab' || o_orderkey AS doi, CASE WHEN o_orderstatus = 'P' THEN '2401.' || o_orderkey END AS arxiv, o_orderpriority AS title, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS venue, o_custkey AS citations FROM orders")
def s24_semantic_scholar_records(spark: SparkSession, d: str) -> DataFrame:
    ids = F.struct(F.concat(F.lit("10.1/AB"), "k").alias("DOI"), F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("2401."), "k")).alias("ArXiv"))
    venue = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))
    payload = F.to_json(F.struct(F.concat(F.lit("s"), "k").alias("paperId"), F.col("o_orderpriority").alias("title"), venue.alias("venue"), F.col("o_custkey").alias("citationCount"), ids.alias("externalIds")))
    r = _orders(spark, d).select("o_orderkey", providers.semantic_scholar(payload).alias("r"))
    return r.select("o_orderkey", "r.s2", "r.doi", "r.arxiv", "r.title", "r.venue", "r.citations")


@query("SELECT o_orderkey, '2401.' || o_orderkey AS arxiv, 'A ' || o_orderpriority AS title, year(o_orderdate)::INTEGER AS year, 'arXiv' AS venue, true AS preprint FROM orders WHERE o_custkey % 5 > 0")
def s25_arxiv_records(spark: SparkSession, d: str) -> DataFrame:
    entry = F.format_string("<entry><id>http://arxiv.org/abs/2401.%sv2</id><published>%s</published><title>A\n  %s</title></entry>", "k", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority")
    feed = F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">'), F.when(F.col("o_custkey") % 5 > 0, entry).otherwise(F.lit("")), F.lit("</feed>"))
    r = _orders(spark, d).select("o_orderkey", providers.arxiv(feed).alias("r")).where("r is not null")
    return r.select("o_orderkey", "r.arxiv", "r.title", "r.year", "r.venue", "r.preprint")


CACHE = "cache AS (SELECT 'https://api.crossref.org/works/10.1/' || p_partkey AS url, max(l_orderkey) AS payload FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 45 GROUP BY p_partkey)"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    url = providers.address("crossref", F.concat(F.lit("10.1/"), _text("l_partkey")), F.lit(None).cast("string"), F.lit(None).cast("string"))
    fresh = t("lineitem").where("l_quantity > 45").select(F.lit("crossref").alias("provider"), url.alias("url"), F.lpad(_text("l_orderkey"), 12, "0").alias("fetched_at"), _text("l_orderkey").alias("payload"))
    none = spark.createDataFrame([], "provider string, url_sha string, url string, fetched_at string, payload string")
    return providers.with_answers(none, fresh)


@query(f"WITH {CACHE} SELECT 'crossref' AS provider, sha256(url) AS url_sha, url, payload::VARCHAR AS payload FROM cache")
def k5_cache_put(spark: SparkSession, d: str) -> DataFrame:
    return _cache(spark, d).select("provider", "url_sha", "url", "payload")


@query(f"WITH {CACHE} SELECT p_partkey, coalesce(payload::VARCHAR, 'cache_miss') AS payload FROM part LEFT JOIN cache ON url = 'https://api.crossref.org/works/10.1/' || p_partkey")
def s21_cache_first(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    url = providers.address("crossref", F.concat(F.lit("https://doi.org/10.1/"), _text("p_partkey")), none, none)
    wanted = Star(spark, d).table("part").select("p_partkey", F.lit("crossref").alias("provider"), url.alias("url"))
    return providers.answered(wanted, _cache(spark, d)).select("p_partkey", F.coalesce("payload", F.lit("cache_miss")).alias("payload"))


@query("SELECT lower(n_name) AS venue, r_name AS category, 'Q' || (1 + n_nationkey % 4) AS quartile FROM nation JOIN region ON n_regionkey = r_regionkey")
def s18_quartile_table(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = F.create_map("r_name", F.concat(F.lit("Q"), (1 + F.col("n_nationkey") % 4).cast("string")))
    return providers.quartile_table(rows.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", inner)))).alias("value")))  # 25 nations


@query(f"WITH RECURSIVE {EVIDENCE} SELECT 'nodes' AS part, kind, count(*) AS n FROM ev_nodes GROUP BY kind UNION ALL SELECT 'edges', kind, count(*) FROM ev_edges GROUP BY kind UNION ALL SELECT 'freshness', 'absent fresh stale', 1")
def k1_index_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The evidence graph written as a snapshot and read again, with what its freshness was before, after, and for another source."""
    star = Star(spark, d)
    folder = state_folder(spark, "index")
    states = [snapshots.freshness(spark, folder, "source-1")]
    tables = snapshots.ensure_snapshot(spark, folder, lambda: {"nodes": star.evidence_nodes(), "edges": star.evidence_edges()}, "source-1", "2024-01-01T00:00:00")
    states += [snapshots.freshness(spark, folder, s) for s in ("source-1", "source-2")]
    counts = [tables[t].groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("part"), "kind", "n") for t in ("nodes", "edges")]
    return counts[0].union(counts[1]).union(spark.createDataFrame([("freshness", " ".join(states), 1)], "part string, kind string, n long"))


# Answers that list several works: an order's lines are what was found for it, or what cites it.


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """``o_orderkey, n, items``: ``l_linenumber, l_partkey`` of each order in order."""
    lines = Star(spark, d).table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    return lines.agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items")).withColumn("k", _text("o_orderkey"))  # one order's lines


def _answer(provider: str, items: Column) -> Column:
    """A search's answer of a provider that names ``items``."""
    part = lambda x: x["l_partkey"].cast("string")
    if provider == "openalex":
        one = lambda x: F.struct(F.concat(F.lit("https://openalex.org/W"), part(x)).alias("id"), F.concat(F.lit("https://doi.org/10.1/P"), part(x)).alias("doi"), F.concat(F.lit("part "), part(x)).alias("display_name"))
        return F.to_json(F.struct(F.transform(items, one).alias("results")))
    if provider == "crossref":
        one = lambda x: F.struct(F.concat(F.lit("10.1/P"), part(x)).alias("DOI"), F.array(F.concat(F.lit("part "), part(x))).alias("title"))
        return F.to_json(F.struct(F.struct(F.transform(items, one).alias("items")).alias("message")))
    if provider == "semanticscholar":
        one = lambda x: F.struct(F.concat(F.lit("s"), part(x)).alias("paperId"), F.concat(F.lit("part "), part(x)).alias("title"), F.struct(F.concat(F.lit("10.1/P"), part(x)).alias("DOI")).alias("externalIds"))
        return F.to_json(F.struct(F.transform(items, one).alias("data")))
    entry = lambda x: F.concat(F.lit("<entry><id>http://arxiv.org/abs/2401."), part(x), F.lit("v3</id><published>2024-01-02</published><title>part\n "), part(x), F.lit("</title></entry>"))
    return F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.transform(items, entry), ""), F.lit("</feed>"))


@query("""SELECT provider, l_orderkey AS o_orderkey, (row_number() OVER (PARTITION BY provider, l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS place, CASE provider WHEN 'openalex' THEN 'W' || l_partkey WHEN 'semanticscholar' THEN 's' || l_partkey WHEN 'arxiv' THEN '2401.' || l_partkey END AS own,
  CASE WHEN provider <> 'arxiv' THEN '10.1/p' || l_partkey END AS doi, 'part ' || l_partkey AS title FROM lineitem, unnest(['openalex', 'crossref', 'semanticscholar', 'arxiv']) p(provider)""")
def s22_search_results(spark: SparkSession, d: str) -> DataFrame:
    lists, out = _lists(spark, d), []
    for provider in providers.READERS:
        found = lists.select("o_orderkey", F.posexplode(providers.search(provider, _answer(provider, F.col("items")))).alias("place", "r"))
        out.append(found.select(F.lit(provider).alias("provider"), "o_orderkey", "place", F.coalesce("r.openalex", "r.s2", "r.arxiv").alias("own"), "r.doi", "r.title"))
    return reduce(DataFrame.union, out)


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'openalex' AS provider, l_orderkey AS o_orderkey, n::VARCHAR AS count, 'W' || l_partkey AS own, '10.1/p' || l_partkey AS doi FROM lineitem JOIN n USING (l_orderkey)
UNION ALL SELECT 'semanticscholar', l_orderkey, NULL, 's' || l_partkey, '10.1/p' || l_partkey FROM lineitem UNION ALL SELECT 'crossref', l_orderkey, n::VARCHAR, NULL, NULL FROM n""")
def s24_cited_by(spark: SparkSession, d: str) -> DataFrame:
    lists, size = _lists(spark, d), F.size("items")
    citing = F.transform("items", lambda x: F.struct(F.struct(F.concat(F.lit("s"), x["l_partkey"].cast("string")).alias("paperId"), F.struct(F.concat(F.lit("10.1/P"), x["l_partkey"].cast("string")).alias("DOI")).alias("externalIds")).alias("citingPaper")))
    answers = {
        "openalex": providers.cited_by("openalex", F.to_json(F.struct(size.alias("cited_by_count"))), _answer("openalex", F.col("items"))), "semanticscholar": providers.cited_by("semanticscholar", F.to_json(F.struct(citing.alias("data")))),
        "crossref": providers.cited_by("crossref", F.to_json(F.struct(F.struct(size.alias("is-referenced-by-count")).alias("message")))),
    }
    rows = [lists.select(F.lit(p).alias("provider"), "o_orderkey", a.alias("c")).select("provider", "o_orderkey", "c.count", F.explode_outer("c.items").alias("x")) for p, a in answers.items()]
    return reduce(DataFrame.union, rows).select("provider", "o_orderkey", _text("count").alias("count"), F.coalesce("x.openalex", "x.s2").alias("own"), "x.doi")
