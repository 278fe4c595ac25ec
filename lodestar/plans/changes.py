"""Queries of changed evidence, reviews, the paged port and expansion over the star tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import evidence, expansion, port
from lodestar.plans.catalog import ORDER_PARENTS, PARENTS
from lodestar.plans.registry import query
from lodestar.plans.retrieval import CLAIM, EVIDENCE
from lodestar.sources.star import LARGE, Star
from lodestar.sources.stored import state_folder
from lodestar.sources.versions import KeyedTable
from lodestar.streaming import updates

KIND = "CASE l_returnflag WHEN 'R' THEN 'disputes' WHEN 'A' THEN 'supports' ELSE 'partially_addresses' END"
SNAPSHOTS = f"""rel AS (SELECT {KIND} AS kind, {CLAIM} AS src, 'gap:supplier-' || l_suppkey AS dst, l_shipdate, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e1 AS (SELECT DISTINCT src || '|' || kind || '|' || dst AS edge, kind, src, dst FROM rel WHERE l_shipdate < TIMESTAMP '2001-06-01'),
e2 AS (SELECT DISTINCT src || '|' || kind || '|' || dst AS edge, kind, src, dst FROM rel WHERE l_shipdate >= TIMESTAMP '1995-02-01'),
n1 AS (SELECT {CLAIM} AS id, 'claim' AS kind, o_orderstatus AS mark, NULL::VARCHAR AS context FROM orders
  UNION ALL SELECT 'work:customer-' || c_custkey, 'work', c_name, c_mktsegment FROM customer UNION ALL SELECT 'gap:supplier-' || s_suppkey, 'gap', s_name, NULL FROM supplier),
n2 AS (SELECT {CLAIM} AS id, 'claim' AS kind, CASE WHEN o_totalprice > 495000 THEN 'X' ELSE o_orderstatus END AS mark, NULL::VARCHAR AS context FROM orders
  UNION ALL SELECT 'work:customer-' || c_custkey, 'work', c_name, CASE WHEN c_acctbal > 9900 THEN 'X' ELSE c_mktsegment END FROM customer
  UNION ALL SELECT 'gap:supplier-' || s_suppkey, 'gap', s_name, NULL FROM supplier WHERE s_acctbal <= 9900),
nd AS (SELECT coalesce(x.id, y.id) AS node, coalesce(y.kind, x.kind) = 'work' AND x.context IS DISTINCT FROM y.context AS ctx FROM n1 x FULL JOIN n2 y ON x.id = y.id
  WHERE x.id IS NULL OR y.id IS NULL OR x.mark IS DISTINCT FROM y.mark OR x.context IS DISTINCT FROM y.context),
nd1 AS (SELECT node FROM nd UNION SELECT {CLAIM} FROM orders JOIN nd ON node = 'work:customer-' || o_custkey AND ctx),
changed_nodes AS (SELECT node FROM nd1 UNION SELECT 'work:' || split_part(substr(node, 7), '#', 1) FROM nd1 WHERE node LIKE 'claim:%'),
changed_edges AS (SELECT coalesce(x.edge, y.edge) AS edge, coalesce(x.kind, y.kind) AS kind, coalesce(x.src, y.src) AS src, coalesce(x.dst, y.dst) AS dst, y.edge IS NULL AS gone FROM e1 x FULL JOIN e2 y ON x.edge = y.edge WHERE x.edge IS NULL OR y.edge IS NULL),
deps AS (SELECT DISTINCT dst AS node_id, 'S1' AS entry, src AS ref FROM rel WHERE l_quantity >= 50
  UNION SELECT 'transfer:order-' || o_orderkey, 'hypothesis', 'gap:supplier-' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice >= {LARGE}
  UNION SELECT 'brief:customer-' || o_custkey, 'B1', {CLAIM} FROM orders WHERE o_totalprice < 3000),
refs AS (SELECT * FROM deps UNION SELECT node_id, entry, node_id FROM deps WHERE node_id LIKE 'gap:%'),
hit AS (SELECT DISTINCT node_id, entry, edge, kind, gone FROM refs JOIN (
  SELECT edge, kind, gone, src AS ref FROM changed_edges UNION ALL SELECT edge, kind, gone, dst FROM changed_edges UNION ALL SELECT edge, kind, gone, 'work:' || split_part(substr(src, 7), '#', 1) FROM changed_edges WHERE src LIKE 'claim:%') USING (ref)),
by_edge AS (SELECT node_id, entry, count(*) AS n, array_to_string(list_sort(list_distinct(list(CASE WHEN gone THEN 'review judgment after evidence relation removal' WHEN kind = 'disputes' THEN 'review whether to question the judgment'
  ELSE 'review whether evidence strengthens the judgment within its conditions' END))), '; ') AS said FROM hit GROUP BY ALL),
by_node AS (SELECT node_id, entry, count(*) AS n FROM refs JOIN changed_nodes ON ref = node GROUP BY ALL),
judged AS (SELECT r.node_id, r.entry, coalesce(a.n, 0) AS changed_nodes, coalesce(b.n, 0) AS changed_edges, coalesce(a.n, 0) + coalesce(b.n, 0) > 0 AS direct, said
  FROM (SELECT DISTINCT node_id, entry FROM refs) r LEFT JOIN by_node a USING (node_id, entry) LEFT JOIN by_edge b USING (node_id, entry)),
reached AS (SELECT DISTINCT node_id, entry FROM refs JOIN (SELECT DISTINCT node_id AS ref FROM judged WHERE direct AND node_id LIKE 'gap:%') USING (ref)),
changes AS (SELECT node_id, entry, changed_nodes, changed_edges, direct OR r.node_id IS NOT NULL AS affected,
  CASE WHEN direct THEN coalesce(said, 'review changed evidence and applicability') WHEN r.node_id IS NOT NULL THEN 'review dependent Gap judgment after evidence changes' ELSE 'retain judgment; no dependency change detected' END AS suggestions
  FROM judged LEFT JOIN reached r USING (node_id, entry))"""


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _node(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind), _text(key))



def _claim() -> Column:
    return F.concat(F.lit("claim:customer-"), _text("o_custkey"), F.lit("#C"), _text("o_orderkey"))


def _relations(star: Star) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "disputes").when(F.col("l_returnflag") == "A", "supports").otherwise("partially_addresses")
    sold = star.table("lineitem").join(star.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return sold.select(kind.alias("kind"), _claim().alias("src"), _node("gap:supplier-", "l_suppkey").alias("dst"), "l_shipdate", "l_quantity")


def _snapshots(star: Star) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes and edges before and after."""
    t, none = star.table, F.lit(None).cast("string")

    def nodes(status: Column, segment: Column, suppliers: DataFrame) -> DataFrame:
        claims = t("orders").select(_claim().alias("id"), F.lit("claim").alias("kind"), status.alias("mark"), none.alias("context"))
        works = t("customer").select(_node("work:customer-", "c_custkey"), F.lit("work"), F.col("c_name"), segment)
        return claims.union(works).union(suppliers.select(_node("gap:supplier-", "s_suppkey"), F.lit("gap"), F.col("s_name"), none))

    before = nodes(F.col("o_orderstatus"), F.col("c_mktsegment"), t("supplier"))
    after = nodes(F.when(F.col("o_totalprice") > 495000, "X").otherwise(F.col("o_orderstatus")), F.when(F.col("c_acctbal") > 9900, "X").otherwise(F.col("c_mktsegment")), t("supplier").where("s_acctbal <= 9900"))
    related = _relations(star)
    edges = [related.where(c).select("kind", "src", "dst", none.alias("mark")).distinct() for c in ("l_shipdate < timestamp '2001-06-01'", "l_shipdate >= timestamp '1995-02-01'")]
    return before, after, edges[0], edges[1]


def _dependencies(star: Star) -> DataFrame:
    large = star.table("orders").where(F.col("o_totalprice") >= LARGE)
    transfers = star.table("lineitem").join(large, F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        _relations(star).where("l_quantity >= 50").select(F.col("dst").alias("node_id"), F.lit("S1").alias("entry"), F.col("src").alias("ref"))
        .union(transfers.select(_node("transfer:order-", "o_orderkey"), F.lit("hypothesis"), _node("gap:supplier-", "l_suppkey")))
        .union(star.table("orders").where("o_totalprice < 3000").select(_node("brief:customer-", "o_custkey"), F.lit("B1"), _claim())).distinct()
    )


def _claim_parents(star: Star) -> DataFrame:
    return star.table("orders").select(_claim().alias("child"), _node("work:customer-", "o_custkey").alias("parent"))


def _changed_nodes(star: Star) -> DataFrame:
    before, after, _, _ = _snapshots(star)
    return evidence.changed_nodes(before, after, _claim_parents(star))


def _changes(star: Star) -> DataFrame:
    _, _, old, new = _snapshots(star)
    return evidence.evidence_changes(_dependencies(star), _changed_nodes(star), evidence.changed_edges(old, new))


@query(f"WITH {SNAPSHOTS} SELECT node FROM changed_nodes")
def j23_changed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _changed_nodes(Star(spark, d))


@query(f"WITH {SNAPSHOTS} SELECT edge, kind, src, dst, gone FROM changed_edges")
def u1_changed_edges(spark: SparkSession, d: str) -> DataFrame:
    _, _, old, new = _snapshots(Star(spark, d))
    return evidence.changed_edges(old, new)


@query(f"WITH {SNAPSHOTS} SELECT * FROM hit")
def j24_touched_judgments(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    _, _, old, new = _snapshots(star)
    deps = _dependencies(star)
    own = deps.where("node_id like 'gap:%'").select("node_id", "entry", F.col("node_id").alias("ref"))
    return evidence.touched(deps.union(own).distinct(), evidence.changed_edges(old, new))


@query(f"WITH {SNAPSHOTS} SELECT * FROM changes")
def q6_evidence_changes(spark: SparkSession, d: str) -> DataFrame:
    return _changes(Star(spark, d))


PREVIOUS = "prev AS (SELECT node_id, entry, 2::BIGINT AS n_events, CASE WHEN length(node_id) % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_reviewed, CASE WHEN length(node_id) % 2 = 0 THEN 'resolved' ELSE 'pending' END AS status FROM (SELECT DISTINCT node_id, entry FROM deps) WHERE node_id NOT LIKE 'brief:%')"


def _previous(star: Star) -> DataFrame:
    even = F.length("node_id") % 2 == 0
    known = _dependencies(star).where("node_id not like 'brief:%'").select("node_id", "entry").distinct()
    return known.select("node_id", "entry", F.lit(2).cast("long").alias("n_events"), F.when(even, 2).otherwise(1).cast("long").alias("n_reviewed"), F.when(even, "resolved").otherwise("pending").alias("status"))


MERGED = """merged AS (SELECT node_id, entry, coalesce(p.n_events, 0) + coalesce(c.affected, false)::BIGINT AS n_events, coalesce(p.n_reviewed, 0) AS n_reviewed,
  CASE WHEN c.affected THEN 'pending' ELSE coalesce(p.status, 'unchanged') END AS status FROM prev p FULL JOIN changes c USING (node_id, entry))"""


@query(f"WITH {SNAPSHOTS}, {PREVIOUS}, {MERGED} SELECT * FROM merged")
def t1_merge_updates(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return evidence.merge_updates(_previous(star), _changes(star))


REVIEWS = "reviews AS (SELECT DISTINCT node_id, entry, CASE WHEN length(node_id) % 5 = 0 THEN 'ignore' ELSE 'revise' END AS decision, CASE WHEN length(node_id) % 7 = 0 THEN ' ' ELSE 'read again' END AS note FROM deps WHERE node_id NOT LIKE 'gap:%1')"


@query(f"""WITH {SNAPSHOTS}, {PREVIOUS}, {MERGED}, {REVIEWS}, o AS (SELECT m.*, CASE WHEN decision IS NULL THEN NULL WHEN decision NOT IN ('retain', 'revise', 'withdraw') OR trim(note) = '' THEN 'invalid_review' WHEN status <> 'pending' THEN 'not_pending' ELSE 'resolved' END AS outcome FROM merged m LEFT JOIN reviews USING (node_id, entry))
SELECT node_id, entry, n_events, CASE WHEN outcome = 'resolved' THEN n_events ELSE n_reviewed END AS n_reviewed, CASE WHEN outcome = 'resolved' THEN 'resolved' ELSE status END AS status, outcome FROM o""")
def t2_resolve_updates(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    size = F.length("node_id")
    reviews = _dependencies(star).where("node_id not like 'gap:%1'").select("node_id", "entry").distinct()
    reviews = reviews.select("node_id", "entry", F.when(size % 5 == 0, "ignore").otherwise("revise").alias("decision"), F.when(size % 7 == 0, " ").otherwise("read again").alias("note"))
    return evidence.resolve_updates(evidence.merge_updates(_previous(star), _changes(star)), reviews)


@query(f"""WITH {SNAPSHOTS}, {PREVIOUS}, {MERGED}, chosen AS (SELECT {CLAIM} AS node FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT 'gap:supplier-1')
SELECT m.* FROM merged m WHERE status = 'pending' AND (node_id IN (SELECT node FROM chosen) OR EXISTS (SELECT 1 FROM deps x WHERE x.node_id = m.node_id AND x.entry = m.entry AND x.ref IN (SELECT node FROM chosen)))""")
def f18_pending_for(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    chosen = star.table("orders").where("o_orderpriority = '1-URGENT'").select(_claim().alias("node")).union(spark.createDataFrame([("gap:supplier-1",)], "node string"))
    return evidence.pending_for(evidence.merge_updates(_previous(star), _changes(star)), _dependencies(star), chosen)


@query(f"""WITH {SNAPSHOTS}, {PREVIOUS}, ev AS (SELECT node_id, entry, row_number() OVER (PARTITION BY node_id, entry ORDER BY edge) AS place, CASE WHEN gone THEN 'gone' ELSE kind END AS suggestion FROM hit)
SELECT node_id, entry, array_to_string(list_sort(list_distinct(list(suggestion))), '; ') AS suggestions FROM ev LEFT JOIN prev USING (node_id, entry) WHERE place > coalesce(n_reviewed, 0) GROUP BY ALL""")
def a16_open_suggestions(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    order = Window.partitionBy("node_id", "entry").orderBy("edge")
    events = j24_touched_judgments(spark, d).select("node_id", "entry", F.row_number().over(order).alias("place"), F.when(F.col("gone"), "gone").otherwise(F.col("kind")).alias("suggestion"))
    return evidence.open_suggestions(events, _previous(star))


@query(f"""WITH {SNAPSHOTS}, t AS (SELECT node FROM changed_nodes UNION SELECT src FROM changed_edges UNION SELECT dst FROM changed_edges), dec AS (
  SELECT 'project-' || (o_custkey % 97) AS project, 'section:' || o_orderpriority AS part, {CLAIM} AS ref FROM orders UNION ALL SELECT 'project-' || (o_custkey % 97), 'argument', 'gap:supplier-' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT project, part, count(DISTINCT ref) AS n_refs, count(DISTINCT CASE WHEN node IS NOT NULL THEN ref END) AS n_touched FROM dec LEFT JOIN t ON ref = node GROUP BY ALL HAVING count(node) > 0""")
def j25_project_impacts(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    _, _, old, new = _snapshots(star)
    edges = evidence.changed_edges(old, new)
    nodes = _changed_nodes(star).union(edges.select("src")).union(edges.select("dst")).distinct()
    project = F.concat(F.lit("project-"), (F.col("o_custkey") % 97).cast("string"))
    orders = star.table("orders")
    declared = orders.select(project.alias("project"), F.concat(F.lit("section:"), "o_orderpriority").alias("part"), _claim().alias("ref"))
    sold = star.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return evidence.project_impacts(declared.union(sold.select(project, F.lit("argument"), _node("gap:supplier-", "l_suppkey"))), nodes)


@query("""WITH b AS (SELECT 'brief:' || event_id AS id, CASE WHEN user_id % 3 > 0 THEN 'topic-' || user_id END AS topic, event_type AS view, strftime(ts, '%Y-%m-%d') AS date FROM events),
l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY coalesce(topic, id), coalesce(view, '') ORDER BY date DESC, id DESC) = 1) SELECT * FROM l ORDER BY date DESC, id DESC LIMIT 3""")
def w4_newest_briefs(spark: SparkSession, d: str) -> DataFrame:
    topic = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("topic-"), _text("user_id")))
    briefs = Star(spark, d).table("events").select(_node("brief:", "event_id").alias("id"), topic.alias("topic"), F.col("event_type").alias("view"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return evidence.latest_briefs(briefs)


@query("""WITH p AS (SELECT event_type AS pool, user_id AS node, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events),
f AS (SELECT node, place > 1 AS late, place, pool FROM p QUALIFY row_number() OVER (PARTITION BY node ORDER BY place > 1, place, pool) = 1)
SELECT node, (row_number() OVER (ORDER BY late, place, pool))::INTEGER AS place FROM (SELECT * FROM f ORDER BY late, place, pool LIMIT 15)""")
def w6_reserve_first(spark: SparkSession, d: str) -> DataFrame:
    pools = Star(spark, d).table("events").select(F.col("event_type").alias("pool"), F.col("user_id").alias("node"), F.struct((-F.col("value")).alias("value"), "event_id").alias("at"))
    return evidence.reserve_first(pools)


# The port.

PORT_SQL = "WITH RECURSIVE {e}, w AS (SELECT id, kind, label, axis, text FROM ev_nodes WHERE kind IN ('work', 'gap')), a AS (SELECT * FROM w WHERE id > 'work:customer-100' ORDER BY id LIMIT 41)"


def _port(spark: SparkSession, d: str) -> port.Port:
    star = Star(spark, d)
    return port.Port(star.evidence_nodes(), star.evidence_parents().union(star.order_parents()), star.evidence_edges())


@query(f"""{PORT_SQL.format(e=EVIDENCE)} SELECT id, kind, label, axis, text, (SELECT count(*) FROM w) AS total, least((SELECT count(*) FROM a), 40)::BIGINT AS returned, (SELECT count(*) FROM a) > 40 AS truncated,
  CASE WHEN (SELECT count(*) FROM a) > 40 THEN (SELECT max(id) FROM (SELECT id FROM a ORDER BY id LIMIT 40)) END AS next_cursor FROM a ORDER BY id LIMIT 40""")
def p2_level_page(spark: SparkSession, d: str) -> DataFrame:
    return _port(spark, d).level(port.HIERARCHY, "work", "work:customer-100", 40)


@query(f"""WITH RECURSIVE {EVIDENCE}, {ORDER_PARENTS}, up AS (SELECT parent FROM (SELECT * FROM ev_parents UNION ALL SELECT * FROM order_parents) WHERE child = 'transfer:order-1'), ap AS (SELECT * FROM ev_parents UNION ALL SELECT * FROM order_parents),
r AS (SELECT DISTINCT 'parent' AS section, NULL AS owner, parent AS item FROM up UNION SELECT 'sibling', parent, child FROM ap WHERE parent IN (SELECT parent FROM up) AND child <> 'transfer:order-1'
  UNION SELECT 'child', NULL, child FROM ap WHERE parent = 'transfer:order-1' UNION SELECT 'edge', NULL, src || '|' || kind || '|' || dst FROM ev_edges WHERE src = 'transfer:order-1' OR dst = 'transfer:order-1'),
k AS (SELECT *, row_number() OVER (PARTITION BY section, owner ORDER BY item) AS n, count(*) OVER (PARTITION BY section, owner) AS total FROM r)
SELECT section, owner, item, total, least(total, 20)::BIGINT AS returned, total > 20 AS truncated, CASE WHEN total > 20 THEN max(item) OVER (PARTITION BY section, owner) END AS next_cursor FROM k WHERE n <= 20""")
def p3_context_pages(spark: SparkSession, d: str) -> DataFrame:
    own = _port(spark, d)
    own.nodes = own.nodes.select("id").union(Star(spark, d).order_parents().select("child").distinct())
    return own.context("transfer:order-1", limit=20)


@query(f"WITH RECURSIVE {EVIDENCE} SELECT level, place, l.kind, count(id) AS n FROM (VALUES ('domain', 0, 'domain'), ('concept', 1, 'concept'), ('work', 2, 'work'), ('work', 2, 'gap')) l(level, place, kind) LEFT JOIN ev_nodes v ON v.kind = l.kind GROUP BY ALL")
def f19_levels(spark: SparkSession, d: str) -> DataFrame:
    return _port(spark, d).sizes()


@query("SELECT 'document:' || doc_id AS id, substr(text, 1, 200000) AS content, length(text) > 200000 AS truncated FROM documents UNION ALL SELECT 'page:' || page_id, substr(html, 1, 200000), length(html) > 200000 FROM pages")
def f16_contents(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    return port.contents_cut(t("documents").select(_node("document:", "doc_id").alias("id"), "text").union(t("pages").select(_node("page:", "page_id"), "html")))


# Expansion: customers of even keys are the library, parts the records that orders refer to or, unless returned, are cited by.

DIRECTION = "CASE {0} WHEN 0 THEN 'references' ELSE 'cited_by' END"
NEIGHBOURS = """own AS (SELECT DISTINCT o_custkey AS node, l_partkey AS part, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS dir FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
nb AS (SELECT node, part, dir, CASE WHEN part % 50 <> 7 THEN CASE WHEN part % 3 = 0 THEN 'title:' ELSE 'doi:10.1/' END || part END AS key, part % 3 > 0 AS verified, c_custkey AS slug
  FROM own LEFT JOIN customer ON c_custkey = part AND c_custkey % 2 = 0)"""


def walk_sql(name: str, seeds: list[int], known: str = "SELECT NULL WHERE false", most: int = expansion.MAX_NEW) -> str:
    """CTEs that end in ``name`` (the walk) and ``name_met`` (each candidate where it was met), from ``nb``."""
    told, out, met = ", ".join(f"({s}, [{i}::BIGINT])" for i, s in enumerate(seeds, 1)), [], []
    ctes = [f"{name}_f1 AS (SELECT * FROM (VALUES {told}) f(node, pos))"]
    for n in (1, 2):
        p, used = f"{name}_", "0" if n == 1 else f"(SELECT count(*) FROM {name}_b1)"
        ctes += [
            f"{p}m{n} AS (SELECT n.*, list_concat(f.pos, [dir::BIGINT, part::BIGINT]) AS pos FROM nb n JOIN {p}f{n} f USING (node))",
            f"{p}c{n} AS (SELECT key, min({{'pos': pos, 'v': verified, 'via': node, 'dir': dir}}) AS x FROM {p}m{n} WHERE slug IS NULL AND key IS NOT NULL AND key NOT IN ({known}) GROUP BY key)",
            f"{p}b{n} AS (SELECT key, x.pos AS pos FROM {p}c{n} WHERE x.v QUALIFY row_number() OVER (ORDER BY x.pos) <= {most} - {used})",
            f"{p}e{n} AS (SELECT CASE WHEN count(*) = {most} - {used} THEN max(pos) END AS cut FROM {p}b{n})",
        ]
        within = "(cut IS NULL OR {} <= cut)"
        out.append(f"SELECT 'hit' AS kind, slug::VARCHAR AS item, node::VARCHAR AS via, {DIRECTION.format('dir')} AS direction, {n} AS depth, min(pos) AS pos FROM {p}m{n}, {p}e{n} WHERE slug IS NOT NULL AND {within.format('pos')} GROUP BY slug, node, dir")
        out.append(f"SELECT CASE WHEN x.v THEN 'new' ELSE 'unverified' END, key, x.via::VARCHAR, {DIRECTION.format('x.dir')}, {n}, x.pos FROM {p}c{n}, {p}e{n} WHERE {within.format('x.pos')}")
        met.append(f"SELECT DISTINCT key, node, dir, {n} AS depth FROM {p}m{n}, {p}e{n} WHERE slug IS NULL AND key IS NOT NULL AND {within.format('pos')}")
        if n == 1:
            ctes.append(f"{p}f2 AS (SELECT slug AS node, min(pos) AS pos FROM {p}m1, {p}e1 WHERE slug IS NOT NULL AND cut IS NULL AND slug NOT IN ({', '.join(map(str, seeds))}) GROUP BY slug)")
            known = f"{known} UNION ALL SELECT key FROM {p}c1"
    return ",\n".join([*ctes, f"{name} AS ({' UNION ALL '.join(out)})", f"{name}_met AS ({' UNION ALL '.join(met)})"])


SEEDS = [1, 7, 12]
WALK = f"{NEIGHBOURS},\n{walk_sql('walk', SEEDS)}"
#: The path to a row as text.
AT = """SELECT * EXCLUDE (pos), array_to_string(pos, '.') AS "at" FROM walk"""


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """``node, direction, place, key, verified, slug`` of customers as works."""
    t = Star(spark, d).table
    direction = F.when(F.col("l_returnflag") == "R", "references").otherwise("cited_by").alias("direction")
    own = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("node"), F.col("l_partkey").alias("part"), direction).distinct()
    library = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("part"), _text("c_custkey").alias("slug"))
    key = F.when(F.col("part") % 50 != 7, F.when(F.col("part") % 3 == 0, _node("title:", "part")).otherwise(_node("doi:10.1/", "part")))
    return own.join(library, "part", "left").select(_text("node").alias("node"), "direction", F.col("part").alias("place"), key.alias("key"), (F.col("part") % 3 > 0).alias("verified"), "slug")


def seeds(spark: SparkSession, keys: list[int]) -> DataFrame:
    return spark.createDataFrame([(str(k), i) for i, k in enumerate(keys, 1)], "node string, seq int")


def _walk(spark: SparkSession, d: str) -> DataFrame:
    return expansion.expand(seeds(spark, SEEDS), neighbours(spark, d))


@query(f"WITH {WALK} {AT}")
def g4_bounded_walk(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d).withColumn("at", F.array_join("at", "."))


@query(f"WITH {WALK} SELECT 50 AS max_new, count(*) FILTER (kind = 'new') AS used, CASE WHEN count(*) FILTER (kind = 'new') >= 50 THEN 'budget_reached' ELSE 'frontier_exhausted' END AS stop_reason FROM walk")
def a15_budget(spark: SparkSession, d: str) -> DataFrame:
    return expansion.budget(_walk(spark, d))


POOL = """disc AS (SELECT o_orderkey AS seq, CASE WHEN o_custkey % 11 > 0 THEN 'doi:10.1/' || (o_custkey % 900) END AS key, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS title, year(o_orderdate)::INTEGER AS year,
  CASE WHEN o_orderstatus <> 'F' THEN '10.1/' || (o_custkey % 900) END AS doi, CASE WHEN o_orderpriority LIKE '1%' THEN 'W' || o_custkey END AS openalex, o_orderpriority AS via, CASE WHEN o_orderkey % 2 = 0 THEN 'references' ELSE 'cited_by' END AS direction, 1 AS depth FROM orders),
pool AS (SELECT key, arg_min(title, seq) FILTER (title IS NOT NULL) AS title, arg_min(year, seq) AS year, arg_min(doi, seq) FILTER (doi IS NOT NULL) AS doi, arg_min(openalex, seq) FILTER (openalex IS NOT NULL) AS openalex,
  max(doi IS NOT NULL OR openalex IS NOT NULL) AS verified, count(DISTINCT (via, direction, depth)) AS n_occurrences FROM disc WHERE key IS NOT NULL GROUP BY key)"""


def _pool(spark: SparkSession, d: str) -> DataFrame:
    key = _node("doi:10.1/", "part")
    orders = Star(spark, d).table("orders").withColumn("part", F.col("o_custkey") % 900)
    return expansion.pool(orders.select(
        F.col("o_orderkey").alias("seq"), F.when(F.col("o_custkey") % 11 > 0, key).alias("key"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("title"), F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") != "F", _node("10.1/", "part")).alias("doi"), F.when(F.startswith("o_orderpriority", F.lit("1")), _node("W", "o_custkey")).alias("openalex"),
        F.col("o_orderpriority").alias("via"), F.when(F.col("o_orderkey") % 2 == 0, "references").otherwise("cited_by").alias("direction"), F.lit(1).alias("depth"),
    ))


@query(f"WITH {POOL} SELECT * FROM pool")
def g5_candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)


@query(f"WITH {POOL}, run AS (SELECT * REPLACE (upper(title) AS title) FROM pool WHERE verified AND year >= 1998) SELECT * FROM run UNION ALL SELECT * FROM pool WHERE key NOT IN (SELECT key FROM run)")
def k13_merge_pools(spark: SparkSession, d: str) -> DataFrame:
    shared = _pool(spark, d)
    return expansion.merge_pools(shared, shared.where("verified and year >= 1998").withColumn("title", F.upper("title")))


@query(f"""WITH {WALK}, cand AS (SELECT 'doi:10.1/' || p_partkey AS key, any_value(p_name) AS title, count(*) AS n_occurrences, any_value(p_size) AS size FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)
SELECT key, title, n_occurrences, CASE WHEN size > 25 THEN 'selected' END AS decision, 50 AS max_new, (SELECT count(*) FROM walk WHERE kind = 'new') AS used,
  CASE WHEN (SELECT count(*) FROM walk WHERE kind = 'new') >= 50 THEN 'budget_reached' ELSE 'frontier_exhausted' END AS stop_reason FROM cand WHERE key IN (SELECT item FROM walk WHERE kind = 'new')""")
def a19_review_batch(spark: SparkSession, d: str) -> DataFrame:
    t = Star(spark, d).table
    seen = t("part").join(t("lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    candidates = seen.groupBy(_node("doi:10.1/", "p_partkey").alias("key")).agg(F.first("p_name").alias("title"), F.count(F.lit(1)).alias("n_occurrences"))
    decisions = t("part").where("p_size > 25").select(_node("doi:10.1/", "p_partkey").alias("key"), F.lit("all").alias("scope"), F.lit("selected").alias("decision"))
    return expansion.review_batch(_walk(spark, d), candidates, decisions, "all")


@query(f"""WITH {POOL}, old AS (SELECT key, CASE WHEN n_occurrences % 2 = 0 THEN 'all' ELSE 'part' END AS scope, 'rejected' AS decision, false AS exploratory FROM pool),
made AS (SELECT key, 'selected' AS decision, key IN ('doi:10.1/5', 'doi:10.1/6') AS exploratory FROM pool WHERE verified)
SELECT key, 'all' AS scope, decision, exploratory FROM made UNION ALL SELECT key, scope, decision, exploratory FROM old WHERE scope <> 'all' OR key NOT IN (SELECT key FROM made)""")
def g6_apply_decisions(spark: SparkSession, d: str) -> DataFrame:
    candidates = _pool(spark, d)
    old = candidates.select("key", F.when(F.col("n_occurrences") % 2 == 0, "all").otherwise("part").alias("scope"), F.lit("rejected").alias("decision"), F.lit(False).alias("exploratory"))
    made = candidates.where("verified").select("key", F.lit("selected").alias("decision"), F.col("key").isin("doi:10.1/5", "doi:10.1/6").alias("exploratory"))
    return expansion.apply_decisions(old, made, candidates.select("key"), "all")


@query("""WITH w AS (SELECT 'work:customer-' || c_custkey AS work, CASE WHEN c_custkey % 10 > 0 THEN 'doi-' || (c_custkey % 1400) END AS doi FROM customer),
once AS (SELECT doi, min(work) AS work FROM w WHERE doi IS NOT NULL GROUP BY doi HAVING count(*) = 1), known AS (SELECT DISTINCT work, 'W' || (c_custkey % 1400) AS record FROM once JOIN customer ON doi = 'doi-' || c_custkey),
refs AS (SELECT 'W' || (o_custkey % 1400) AS record, 'W' || l_partkey AS cited FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT DISTINCT s.work AS src, t.work AS dst FROM refs r JOIN known s ON r.record = s.record JOIN known t ON r.cited = t.record WHERE s.work <> t.work""")
def j12_citation_overlay(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    customers = star.table("customer").withColumn("k", F.col("c_custkey") % 1400)
    works = customers.select(_node("work:customer-", "c_custkey").alias("work"), F.when(F.col("c_custkey") % 10 > 0, _node("DOI-", "k")).alias("doi"))
    records = customers.select(_node("doi-", "c_custkey").alias("doi"), _node("W", "k").alias("record"))
    sold = star.table("orders").join(star.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("k", F.col("o_custkey") % 1400)
    return expansion.citation_overlay(works, records, sold.select(_node("W", "k").alias("record"), _node("W", "l_partkey").alias("cited")))


# The log of judgments: each event of a user is a change or a review of one of their entries.

LOG = """log AS (SELECT 'gap:' || user_id AS node_id, event_type AS entry, event_id AS seq, event_id % 3 > 0 AS affected, ['s' || (event_id % 4), 't' || (event_id % 2)] AS suggestions,
  CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 5 = 0 THEN 'ignore' ELSE 'revise' END END AS decision, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'read' END AS note FROM events)"""
REVIEWED = f"""{LOG}, rel AS (SELECT *, decision IS NULL AND affected AS event FROM log WHERE decision IS NULL OR (decision IN ('retain', 'revise', 'withdraw') AND trim(note) <> '')),
num AS (SELECT *, sum(event::INT) OVER (PARTITION BY node_id, entry ORDER BY seq) AS n FROM rel),
st AS (SELECT node_id, entry, max(n)::BIGINT AS n_events, coalesce(max(n) FILTER (decision IS NOT NULL), 0)::BIGINT AS n_reviewed, bool_or(decision IS NULL) AS told FROM num GROUP BY ALL),
said AS (SELECT node_id, entry, array_to_string(list_sort(list_distinct(flatten(list(suggestions)))), '; ') AS suggestions FROM num JOIN st USING (node_id, entry) WHERE event AND n > n_reviewed GROUP BY ALL)
SELECT node_id, entry, n_events, n_reviewed, CASE WHEN n_events = 0 THEN 'unchanged' WHEN n_reviewed < n_events THEN 'pending' ELSE 'resolved' END AS status, coalesce(suggestions, '') AS suggestions FROM st LEFT JOIN said USING (node_id, entry) WHERE told"""


def _log(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(
        _node("gap:", "user_id").alias("node_id"), F.col("event_type").alias("entry"), e.cast("long").alias("seq"), (e % 3 > 0).alias("affected"),
        F.array(F.concat(F.lit("s"), (e % 4).cast("string")), F.concat(F.lit("t"), (e % 2).cast("string"))).alias("suggestions"),
        F.when(e % 7 == 0, F.when(e % 5 == 0, "ignore").otherwise("revise")).alias("decision"), F.when(e % 4 == 0, " ").otherwise("read").alias("note"),
    )


@query(f"WITH {REVIEWED}")
def t1_reviewed_log(spark: SparkSession, d: str) -> DataFrame:
    return evidence.reviewed_log(_log(Star(spark, d).table("events")))


@query(f"WITH {REVIEWED}")
def t1_streamed_log(spark: SparkSession, d: str) -> DataFrame:
    """The same log as a stream: its state is kept between micro-batches, its judgments in a keyed table."""
    events = Star(spark, d).table("events")
    state = state_folder(spark, "judgments")
    table = KeyedTable(spark, f"{state}/table", list(updates.KEYS), parts=8)
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")  # a pattern may be one file, a plain path not
    updates.follow(_log(stream), table, f"{state}/checkpoint").awaitTermination()
    return table.read()
