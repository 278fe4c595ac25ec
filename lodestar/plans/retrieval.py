"""Queries of retrieval, corridors and novelty over the evidence graph of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import STOPWORDS, TERM
from lodestar.operators import graph, retrieval
from lodestar.plans.catalog import PARENTS
from lodestar.plans.registry import query
from lodestar.sources.star import LARGE, MANY, Star
from lodestar.sources.stored import stored

QUESTION = "Which red widget do suppliers of the Middle East lack in furniture, and how about a small bolt?"

# The evidence graph of lodestar.sources.star in SQL.
AXIS = "CASE p_size % 3 WHEN 0 THEN 'pattern' WHEN 1 THEN 'function' ELSE 'failure-mode' END"
CLAIM = "'claim:customer-' || o_custkey || '#C' || o_orderkey"
EVIDENCE = f"""{PARENTS},
ev_nodes AS (SELECT *, lower(concat_ws(' ', label, id, axis)) AS text FROM (
  SELECT 'domain:' || r_name AS id, 'domain' AS kind, r_name AS label, NULL::VARCHAR AS axis FROM region
  UNION ALL SELECT 'concept:' || n_name, 'concept', n_name, 'task' FROM nation
  UNION ALL SELECT 'concept:part-' || p_partkey, 'concept', p_name, {AXIS} FROM part
  UNION ALL SELECT 'work:customer-' || c_custkey, 'work', c_name || ' ' || c_mktsegment, NULL FROM customer
  UNION ALL SELECT 'gap:supplier-' || s_suppkey, 'gap', s_name, NULL FROM supplier
  UNION ALL SELECT {CLAIM}, 'claim', 'C' || o_orderkey || ': ' || o_orderpriority, NULL FROM orders
  UNION ALL SELECT 'transfer:order-' || o_orderkey, 'transfer', 'order ' || o_orderkey, NULL FROM orders WHERE o_totalprice >= {LARGE})),
ev_parents AS (SELECT * FROM parents UNION ALL SELECT {CLAIM}, 'work:customer-' || o_custkey FROM orders),
many AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_quantity >= {MANY}),
ev_edges AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 'retracted_claims' ELSE 'claims' END AS kind, 'work:customer-' || o_custkey AS src, {CLAIM} AS dst FROM orders
  UNION ALL SELECT DISTINCT 'tag:' || {AXIS}, 'work:customer-' || o_custkey, 'concept:part-' || l_partkey FROM many JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT DISTINCT 'concerns', 'gap:supplier-' || l_suppkey, 'concept:part-' || l_partkey FROM many
  UNION ALL SELECT DISTINCT 'binds', {CLAIM}, 'concept:part-' || l_partkey FROM many JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'
  UNION ALL SELECT DISTINCT 'transfer-from', 'transfer:order-' || o_orderkey, 'concept:' || n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice >= {LARGE}
  UNION ALL SELECT DISTINCT 'transfer-to', 'transfer:order-' || o_orderkey, 'concept:' || n_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE o_totalprice >= {LARGE}),
reach AS (SELECT child AS node, parent AS ancestor FROM ev_parents UNION SELECT r.node, p.parent FROM reach r JOIN ev_parents p ON r.ancestor = p.child),
closure AS (SELECT DISTINCT node, ancestor AS domain FROM reach WHERE ancestor LIKE 'domain:%' UNION SELECT parent, parent FROM parents WHERE parent LIKE 'domain:%')"""
CORRIDORS = """moving AS (SELECT * FROM ev_edges WHERE src LIKE 'transfer:%'),
touched AS (SELECT DISTINCT src AS via, domain FROM moving JOIN closure ON dst = node),
ends AS (SELECT src AS via, array_to_string(list_sort(list(kind || '->' || dst)), '|') AS ends FROM moving GROUP BY src),
attached AS (SELECT DISTINCT src AS node, dst AS concept, domain FROM ev_edges JOIN closure ON src = node
  WHERE kind IN ('tag:pattern', 'tag:function', 'tag:failure-mode', 'concerns') AND split_part(src, ':', 1) IN ('work', 'gap')),
sides AS (SELECT concept, domain, count(*) AS n, array_to_string(list_sort(list(node))[1:3], '|') AS first FROM attached GROUP BY ALL),
every AS (
  SELECT x.domain AS a, y.domain AS c, 'transfer' AS kind, NULL::VARCHAR AS axis, -1 AS rank, x.via, ends, NULL::VARCHAR AS side_a, NULL::VARCHAR AS side_b, 0::BIGINT AS n_a, 0::BIGINT AS n_c
    FROM touched x JOIN touched y ON x.via = y.via AND x.domain < y.domain JOIN ends e ON e.via = x.via
  UNION ALL SELECT x.domain, y.domain, 'shared-axis', axis, list_position(['pattern', 'function', 'failure-mode'], axis), x.concept, NULL, x.first, y.first, x.n, y.n
    FROM sides x JOIN sides y ON x.concept = y.concept AND x.domain < y.domain JOIN ev_nodes v ON v.id = x.concept WHERE axis IN ('pattern', 'function', 'failure-mode')),
placed AS (SELECT a, c, row_number() OVER (PARTITION BY a, c ORDER BY rank, via) AS place, kind, axis, via, ends, side_a, side_b, n_a, n_c, count(*) OVER (PARTITION BY a, c) AS total FROM every),
corridors AS (SELECT a, c, place::INTEGER AS place, kind, axis, via, ends, side_a, side_b, n_a, n_c, total, least(total, 15)::BIGINT AS returned, total > 15 AS truncated FROM placed WHERE place <= 15)"""
def terms_sql(question: str) -> str:
    """``term, pos`` of a question: its own terms without stopwords, then names of regions in it."""
    asked, stop = question.lower(), ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"""SELECT term, min(pos) AS pos FROM (
  SELECT unnest(w) AS term, [0, generate_subscripts(w, 1)] AS pos FROM (SELECT regexp_extract_all('{asked}', '{TERM}') AS w)
  UNION ALL SELECT unnest([lower(r_name), r_name]), [1, unnest([2 * k, 2 * k + 1])] FROM (SELECT r_name, row_number() OVER (ORDER BY r_name) AS k FROM region WHERE contains('{asked}', lower(r_name))
    AND (NOT regexp_full_match(lower(r_name), '[a-z0-9]+') OR regexp_matches('{asked}', '(^|[^a-z0-9])' || lower(r_name) || '([^a-z0-9]|$)'))))
  WHERE term NOT IN ({stop}) OR pos[1] = 1 GROUP BY term"""


HITS = f"""terms AS ({terms_sql(QUESTION)}), hits AS (SELECT id, kind, term FROM ev_nodes, terms WHERE CASE WHEN regexp_full_match(term, '[a-z0-9]+') THEN regexp_matches(text, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') ELSE contains(text, term) END),
concepts AS (SELECT id, 'concept:' || id || ' (term:' || term || ')' AS reason FROM hits WHERE kind IN ('concept', 'domain')),
pointed AS (SELECT src AS node, reason FROM concepts JOIN ev_edges ON id = dst),
by_terms AS (SELECT DISTINCT node, reason FROM (
  SELECT id AS node, 'term:' || term AS reason FROM hits WHERE kind IN ('work', 'gap')
  UNION ALL SELECT parent, 'claim:' || id || ' (term:' || term || ')' FROM hits JOIN ev_parents ON id = child WHERE kind = 'claim'
  UNION ALL SELECT * FROM pointed
  UNION ALL SELECT parent, reason FROM pointed JOIN ev_parents ON node = child WHERE node LIKE 'claim:%'
  UNION ALL SELECT child, reason FROM concepts JOIN ev_parents ON id = parent) WHERE split_part(node, ':', 1) IN ('work', 'gap')),
hit_pairs AS (SELECT x.domain AS a, y.domain AS c FROM (SELECT DISTINCT domain FROM by_terms NATURAL JOIN closure) x JOIN (SELECT DISTINCT domain FROM by_terms NATURAL JOIN closure) y ON x.domain < y.domain),
reasons AS (SELECT DISTINCT node, reason FROM (SELECT node, reason FROM by_terms UNION ALL SELECT unnest(string_split(side_a || '|' || side_b, '|')), 'corridor:' || via FROM corridors SEMI JOIN hit_pairs USING (a, c) WHERE kind = 'shared-axis'))"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The evidence graph, written once: each of its tables is a join of several of the star's."""
    star = Star(spark, d)
    return stored(star.evidence_nodes()), stored(star.evidence_parents()), stored(star.evidence_edges())


def _bridges(nodes: DataFrame, parents: DataFrame, edges: DataFrame) -> retrieval.Bridges:
    return retrieval.bridges(nodes, edges, stored(graph.domain_closure(parents)))


def _terms(spark: SparkSession, d: str) -> list[str]:
    regions = Star(spark, d).table("region").select(F.col("r_name").alias("slug"), F.col("r_name").alias("alias"))
    return retrieval.query_terms(QUESTION, regions)


@query(f"SELECT term, (row_number() OVER (ORDER BY pos))::INTEGER AS place FROM ({terms_sql(QUESTION)})")
def f6_query_terms(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(_terms(spark, d), 1)], "term string, place int")


@query(f"WITH RECURSIVE {EVIDENCE}, {CORRIDORS}, {HITS} SELECT id, kind, term FROM hits")
def f3_term_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_hits(Star(spark, d).evidence_nodes(), _terms(spark, d))


@query("SELECT id, text FROM (WITH RECURSIVE " + EVIDENCE + " SELECT id, text FROM ev_nodes)")
def f4_search_text(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).evidence_nodes().select("id", "text")


@query(f"WITH RECURSIVE {EVIDENCE}, {CORRIDORS}, {HITS} SELECT * FROM by_terms")
def j15_reached_by_terms(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.reached_by_terms(*_graph(spark, d), _terms(spark, d))


@query(f"WITH RECURSIVE {EVIDENCE}, {CORRIDORS}, {HITS} SELECT parent AS node, 'claim:' || id || ' (term:' || term || ')' AS reason FROM hits JOIN ev_parents ON id = child WHERE kind = 'claim' AND term = 'in' UNION ALL SELECT parent, 'claim:' || child || ' (term:urgent)' FROM ev_parents JOIN ev_nodes ON id = child WHERE kind = 'claim' AND regexp_matches(text, '(^|[^a-z0-9])urgent([^a-z0-9]|$)')")
def j16_works_of_claims(spark: SparkSession, d: str) -> DataFrame:
    nodes, parents, edges = _graph(spark, d)
    return retrieval.reached_by_terms(nodes.where("kind in ('claim', 'work')"), parents, edges, ["in", "urgent"])


@query(f"WITH RECURSIVE {EVIDENCE}, {CORRIDORS} SELECT * FROM corridors")
def q3_corridors(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.shown(retrieval.corridors(_bridges(*_graph(spark, d))))


@query(f"WITH RECURSIVE {EVIDENCE}, {CORRIDORS} SELECT * FROM corridors WHERE a = 'domain:ASIA' AND c = 'domain:EUROPE'")
def w8_corridors_of_a_pair(spark: SparkSession, d: str) -> DataFrame:
    pair = spark.createDataFrame([("domain:ASIA", "domain:EUROPE")], "a string, c string")
    return retrieval.shown(retrieval.corridors(_bridges(*_graph(spark, d)), pairs=pair))


@query(f"WITH RECURSIVE {EVIDENCE}, {CORRIDORS} SELECT x.domain AS a, y.domain AS c, x.via, ends FROM touched x JOIN touched y ON x.via = y.via AND x.domain < y.domain JOIN ends e ON e.via = x.via QUALIFY row_number() OVER (PARTITION BY x.domain, y.domain ORDER BY x.via) <= 15")
def j17_transfer_corridors(spark: SparkSession, d: str) -> DataFrame:
    nodes, parents, edges = _graph(spark, d)
    moving = edges.where("kind in ('transfer-from', 'transfer-to')")
    return retrieval.shown(retrieval.corridors(_bridges(nodes, parents, moving))).select("a", "c", "via", "ends")


@query(f"WITH RECURSIVE {EVIDENCE}, {CORRIDORS} SELECT DISTINCT a, c, total, returned, truncated FROM corridors")
def a8_corridor_totals(spark: SparkSession, d: str) -> DataFrame:
    return q3_corridors(spark, d).select("a", "c", "total", "returned", "truncated").distinct()


@query(f"WITH RECURSIVE {EVIDENCE}, {CORRIDORS}, {HITS} SELECT node, count(*) AS n FROM reasons GROUP BY node")
def a7_reasons_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.candidate_reasons(*_graph(spark, d), _terms(spark, d)).groupBy("node").agg(F.count_distinct("reason").alias("n"))


@query(f"""WITH RECURSIVE {EVIDENCE}, {CORRIDORS}, {HITS}, best AS (SELECT node, count(*) AS n, array_to_string(list_sort(list(reason)), '; ') AS why FROM reasons GROUP BY node ORDER BY n DESC, node LIMIT 15)
SELECT row_number() OVER (ORDER BY n DESC, node)::INTEGER AS place, node, n, why FROM best""")
def q2_candidates(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.ranked_candidates(retrieval.candidate_reasons(*_graph(spark, d), _terms(spark, d)))


@query(f"""WITH RECURSIVE {EVIDENCE}, {CORRIDORS}, {HITS} SELECT node, max(reason LIKE 'term:%' OR reason LIKE 'claim:%') AS direct, count(*) AS n FROM reasons GROUP BY node ORDER BY direct DESC, n DESC, node LIMIT 15""")
def w2_research_order(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.research_order(retrieval.candidate_reasons(*_graph(spark, d), _terms(spark, d)))


@query(f"""WITH RECURSIVE {EVIDENCE}, {CORRIDORS}, {HITS},
best AS (SELECT row_number() OVER (ORDER BY n DESC, node) AS k, * FROM (SELECT node, count(*) AS n, array_to_string(list_sort(list(reason)), '; ') AS why FROM reasons GROUP BY node ORDER BY n DESC, node LIMIT 15)),
hd AS (SELECT DISTINCT domain FROM best NATURAL JOIN closure), pairs2 AS (SELECT x.domain AS a, y.domain AS c FROM hd x JOIN hd y ON x.domain < y.domain),
once AS (SELECT * FROM corridors SEMI JOIN pairs2 USING (a, c) QUALIFY row_number() OVER (PARTITION BY kind, via, ends, side_a, side_b ORDER BY a, c, place) = 1),
found AS (SELECT *, row_number() OVER (ORDER BY a, c, place) AS pos FROM once), kept AS (SELECT * FROM found WHERE pos <= 10),
touching AS (SELECT pos, 'corridor:' || via AS why, list_concat(string_split(coalesce(side_a, ''), '|'), string_split(coalesce(side_b, ''), '|'), list_transform(string_split(coalesce(ends, ''), '|'), lambda x: string_split(x, '->')[-1])) AS t FROM kept),
listed AS (SELECT 0 AS pos, why, k, node FROM best UNION ALL SELECT pos, why, unnest(range(len(t))), unnest(t) FROM touching),
works AS (SELECT node, why, row_number() OVER (ORDER BY pos, k) AS place FROM (SELECT * FROM listed WHERE node LIKE 'work:%' QUALIFY row_number() OVER (PARTITION BY node ORDER BY pos, k) = 1)),
top_works AS (SELECT * FROM works WHERE place <= 15),
cl AS (SELECT dst, place FROM ev_edges JOIN top_works ON src = node WHERE kind = 'claims')
SELECT 'corridors' AS stage, pos::INTEGER AS place, via AS id, a || ' ' || c AS why, (SELECT count(*) FROM found) AS total, (SELECT count(*) FROM found) > 10 AS truncated FROM kept
UNION ALL SELECT 'works', place::INTEGER, node, why, (SELECT count(*) FROM works), (SELECT count(*) FROM works) > 15 FROM top_works
UNION ALL SELECT 'claims', (row_number() OVER (ORDER BY place, dst))::INTEGER, dst, NULL, (SELECT count(*) FROM cl), (SELECT count(*) FROM cl) > 30 FROM (SELECT * FROM cl ORDER BY place, dst LIMIT 30)""")
def q4_novelty(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.novelty(*_graph(spark, d), _terms(spark, d))


@query(f"""WITH RECURSIVE {EVIDENCE}, sel AS (SELECT 'work:customer-' || c_custkey AS node FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_mktsegment = 'MACHINERY'),
o AS (SELECT DISTINCT domain FROM sel NATURAL JOIN closure), att AS (SELECT DISTINCT dst AS via, src AS node FROM ev_edges JOIN ev_nodes v ON v.id = dst WHERE ev_edges.kind IN ('tag:pattern', 'tag:function', 'tag:failure-mode', 'concerns') AND axis IN ('pattern', 'function', 'failure-mode') AND dst <> 'concept:part-1'),
loc AS (SELECT via, count(*) AS local FROM att SEMI JOIN sel USING (node) GROUP BY via),
fr AS (SELECT a.node, min(a.via) AS via FROM att a JOIN loc USING (via) JOIN closure c ON c.node = a.node WHERE a.node LIKE 'work:%' AND a.node NOT IN (SELECT node FROM sel) AND c.domain NOT IN (SELECT domain FROM o) GROUP BY a.node)
SELECT node, via, local FROM fr JOIN loc USING (via) ORDER BY via, node LIMIT 3""")
def j21_foreign_candidates(spark: SparkSession, d: str) -> DataFrame:
    nodes, parents, edges = _graph(spark, d)
    star = Star(spark, d)
    chosen = star.table("customer").join(star.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey = 2 and c_mktsegment = 'MACHINERY'")
    chosen = chosen.select(F.concat(F.lit("work:customer-"), F.col("c_custkey").cast("string")).alias("node"))
    return retrieval.foreign_candidates(nodes, edges, stored(graph.domain_closure(parents)), chosen, ["part-1"])
