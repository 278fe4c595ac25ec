"""Operators of evidence, port, expansion, impact and records on small fixtures, at their limits and with odd rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators import change, evidence, expansion, graph, impact, network, port, ranking, records, retrieval


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def chain(spark, n):
    return spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n)], "child string, parent string")


def test_closure_is_as_deep_as_the_hierarchy_and_ends_in_cycles(spark):
    assert graph.ancestors(chain(spark, 60)).count() == 60 * 61 // 2
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("x", "a")], "child string, parent string")
    assert rows(graph.ancestors(loop), "node", "ancestor") == sorted([(n, m) for n in "abcx" for m in "abc"])
    start = spark.createDataFrame([("x",)], "node string")
    assert rows(graph.ancestors(loop, start, "b"), "node", "ancestor") == [("x", "b")]
    assert graph.ancestors(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_propagation_is_as_deep_as_the_dependencies(spark):
    depends = chain(spark, 70).selectExpr("parent as node", "child as on")
    assert change.affected(spark.createDataFrame([("n0",)], "node string"), depends).count() == 71


def test_snapshot_diff_sees_columns_of_one_side(spark):
    before = spark.createDataFrame([(1, "a"), (2, None)], "k int, x string")
    after = spark.createDataFrame([(1, "a", "new"), (2, None, None), (3, None, None)], "k int, x string, y string")
    assert rows(change.snapshot_diff(before, after, "k"), "k", "change") == [(1, "changed"), (3, "added")]


def test_round_robin_numbers_keys_before_it_cuts(spark):
    lane = spark.createDataFrame([("l", i, k) for i, k in enumerate(["x"] * 5 + ["k0", "k1"])], "lane string, place int, key string")
    assert rows(ranking.round_robin(lane, "lane", "place", "key", 3), "turn", "key") == [(1, "x"), (2, "k0"), (3, "k1")]


@pytest.mark.parametrize(("preprint", "reviewed", "age", "want"), [
    (False, True, 0, "medium"), (False, True, 2, "medium"), (False, True, 3, "low"), (False, True, -1, "low"), (True, True, 1, "low"), (False, False, 1, "low"), (None, True, None, "low"),
])
def test_floor_of_bands(spark, preprint, reviewed, age, want):
    x = spark.createDataFrame([(10.0, None, preprint, reviewed, age)], "c double, q string, p boolean, r boolean, a int")
    assert x.select(impact.band(*map(F.col, "cqpra"))["band"]).first()[0] == want


def test_categories_stay_apart_and_unknown_stays_unknown(spark):
    snaps = spark.createDataFrame([("w", "Nature", ["a", "b"], None, False, False, 5), ("v", "X", [], None, None, None, None)], "work string, venue string, categories array<string>, percentile double, preprint boolean, reviewed boolean, age int")
    quartiles = spark.createDataFrame([("nature", "a", "Q1"), ("nature", "b", "Q4")], "venue string, category string, quartile string")
    assert rows(impact.bands_by_category(snaps, quartiles), "work", "category", "band", "channel", "coarse") == [("v", "(uncategorized)", "unknown", "none", False), ("w", "a", "high", "venue", True), ("w", "b", "low", "venue", True)]


def test_citations_that_are_no_number(spark):
    cards = spark.createDataFrame([(1, "12 (2024-01)"), (2, "about 5"), (3, None), (4, ""), (5, "7")], "work int, citations string")
    snaps = spark.createDataFrame([(1, 15), (2, 9), (3, 9), (4, 9), (5, None)], "work int, citations long")
    assert rows(impact.citations_report(cards, snaps), "work", "recorded", "delta") == [(1, "12", "3"), (2, "about", "n/a"), (3, "?", "n/a"), (4, "?", "n/a")]


def a_port(spark):
    nodes = spark.createDataFrame([("domain:d", "domain", "D"), *((f"work:{i:02}", "work", str(i)) for i in range(12))], "id string, kind string, label string")
    parents = spark.createDataFrame([(f"work:{i:02}", "domain:d") for i in range(12)], "child string, parent string")
    edges = spark.createDataFrame([("related", "work:00", "work:01")], "kind string, src string, dst string")
    contents = spark.createDataFrame([("work:00", "x" * 200_001), ("work:01", None)], "id string, text string")
    return port.Port(nodes, parents, edges, contents, "s1")


def test_port_pages_follow_cursors_to_the_end(spark):
    own, cursor, seen = a_port(spark), None, []
    while True:
        page = own.level("evidence", "work", cursor, 5).collect()
        seen += [r.id for r in page]
        assert {(r.total, r.returned) for r in page} == {(12, len(page))}
        cursor = page[0].next_cursor
        if not page[0].truncated:
            break
    assert seen == [f"work:{i:02}" for i in range(12)] and cursor is None
    assert len(own.level("evidence", "work", limit=0).collect()) == 1


def test_port_context_and_errors(spark):
    own = a_port(spark)
    got = own.context("work:00", limit=3).collect()
    assert [(r.item, r.total, r.truncated, r.next_cursor) for r in sorted(got, key=lambda r: r.item) if r.section == "sibling"] == [(f"work:{i:02}", 11, True, "work:03") for i in (1, 2, 3)]
    assert {r.section for r in got} == {"parent", "sibling", "edge"}
    after = own.context("work:00", limit=3, cursors={"sibling": "work:10"}).where("section = 'sibling'").collect()
    assert [(r.item, r.truncated) for r in after] == [("work:11", False)]
    assert [(r.truncated, len(r.content)) for r in own.content("work:00").collect()] == [(True, 200_000)]
    codes = [own.envelope("level", "other", "work"), own.envelope("level", "evidence", "x"), own.envelope("level", "evidence", "work", "no"), own.envelope("context", "work:99"), own.envelope("context", "work:00", "domain:x"), own.envelope("content", "work:99")]
    assert [c["error"] for c in codes] == ["unknown_hierarchy", "invalid_request", "bad_cursor", "unknown_node", "invalid_request", "unknown_node"]
    assert own.envelope("levels", spark)["ok"] and port.Port.hierarchies(spark).count() == 1


def test_evidence_changes_reach_gaps_of_gaps(spark):
    nodes = "id string, kind string, mark string, context string"
    before = spark.createDataFrame([("work:w", "work", "m", "old"), ("claim:w#C1", "claim", "q", None), ("gap:a", "gap", "m", None)], nodes)
    after = spark.createDataFrame([("work:w", "work", "m", "new"), ("claim:w#C1", "claim", "q", None), ("gap:a", "gap", "m", None)], nodes)
    parents = spark.createDataFrame([("claim:w#C1", "work:w")], "child string, parent string")
    changed = evidence.changed_nodes(before, after, parents)
    assert rows(changed, "node") == [("claim:w#C1",), ("work:w",)]
    deps = spark.createDataFrame([("gap:a", "S1", "claim:w#C1"), ("gap:b", "S1", "gap:a"), ("brief:x", "B", "gap:b"), ("brief:y", "B", "gap:z")], "node_id string, entry string, ref string")
    edges = spark.createDataFrame([], "edge string, kind string, src string, dst string, gone boolean")
    got = {r.node_id: (r.affected, r.suggestions) for r in evidence.evidence_changes(deps, changed, edges).collect()}
    assert got == {"gap:a": (True, evidence.ANY_CHANGE), "gap:b": (True, evidence.BY_GAP), "brief:x": (True, evidence.BY_GAP), "brief:y": (False, evidence.NO_CHANGE)}


def test_reviews_cover_events_and_later_changes_reopen(spark):
    kept = "node_id string, entry string, n_events long, n_reviewed long, status string"
    stored = spark.createDataFrame([("a", "1", 1, 0, "pending"), ("b", "1", 0, 0, "unchanged")], kept)
    reviews = spark.createDataFrame([("a", "1", "retain", "fine"), ("b", "1", "retain", "fine")], "node_id string, entry string, decision string, note string")
    done = evidence.resolve_updates(stored, reviews)
    assert rows(done, "node_id", "n_reviewed", "status", "outcome") == [("a", 1, "resolved", "resolved"), ("b", 0, "unchanged", "not_pending")]
    changes = spark.createDataFrame([("a", "1", True), ("b", "1", False), ("c", "1", False)], "node_id string, entry string, affected boolean")
    assert rows(evidence.merge_updates(done, changes), "node_id", "n_events", "n_reviewed", "status") == [("a", 2, 1, "pending"), ("b", 0, 0, "unchanged"), ("c", 0, 0, "unchanged")]


NEIGHBOURS = "node string, direction string, place int, key string, verified boolean, slug string"
WALK = [
    ("s", "cited_by", 1, "k1", True, None), ("s", "references", 2, "x", True, "h"), ("s", "references", 9, "title:t", False, None), ("s", "cited_by", 3, "k2", True, None), ("s", "cited_by", 4, "y", True, "s"),
    ("s", "cited_by", 2, "x", True, "h"), ("s", "cited_by", 5, None, False, None),
    ("h", "references", 1, "k1", True, None), ("h", "references", 2, "k3", True, None), ("h", "cited_by", 3, "z", True, "g"), ("g", "references", 1, "k4", True, None), ("h", "references", 4, "title:t", False, None),
]


def test_walk_stops_at_its_budget_and_hits_walk_on(spark):
    neighbours = spark.createDataFrame(WALK, NEIGHBOURS)
    seeds = spark.createDataFrame([("s", 1)], "node string, seq int")
    full = expansion.expand(seeds, neighbours)
    assert rows(full.where("kind = 'new'"), "item", "depth") == [("k1", 1), ("k2", 1), ("k3", 2)]
    assert rows(full.where("kind = 'unverified'"), "item", "depth") == [("title:t", 1)]
    assert rows(full.where("kind = 'hit'"), "item", "direction", "depth") == [("g", "cited_by", 2), ("h", "cited_by", 1), ("h", "references", 1), ("s", "cited_by", 1)]
    assert expansion.stop_reason(full) == "frontier_exhausted"
    short = expansion.expand(seeds, neighbours, max_new=1)
    assert rows(short, "kind", "item", "direction") == [("hit", "h", "references"), ("new", "k1", "cited_by"), ("unverified", "title:t", "references")]
    assert expansion.stop_reason(short, 1) == "budget_reached"
    assert rows(expansion.budget(short, 1), "max_new", "used", "stop_reason") == [(1, 1, "budget_reached")]


def test_candidates_without_identifiers_use_no_budget(spark):
    found = [("s", "references", i, k, k.startswith("doi"), None) for i, k in enumerate(["title:a", "title:b", "doi:c", "doi:d", "doi:e"])]
    got = expansion.expand(spark.createDataFrame([("s", 1)], "node string, seq int"), spark.createDataFrame(found, NEIGHBOURS), max_new=2)
    assert rows(got, "kind", "item") == [("new", "doi:c"), ("new", "doi:d"), ("unverified", "title:a"), ("unverified", "title:b")]
    known = spark.createDataFrame([("doi:c",), ("title:b",)], "key string")
    got = expansion.expand(spark.createDataFrame([("s", 1)], "node string, seq int"), spark.createDataFrame(found, NEIGHBOURS), max_new=2, known=known)
    assert rows(got, "kind", "item") == [("new", "doi:d"), ("new", "doi:e"), ("unverified", "title:a")]


def test_a_level_tells_what_it_left_out(spark):
    frontier = spark.createDataFrame([("s", [1]), ("h", [2]), ("lost", [3])], "node string, at array<long>")
    met = expansion.level(frontier, spark.createDataFrame(WALK, NEIGHBOURS), 1, 50, identified=spark.createDataFrame([("s",), ("h",)], "node string"), walked=frontier.select("node"))
    assert rows(met.warnings, "warning") == [("no_ids:lost",), ("unidentifiable:s",)]
    assert rows(met.expanded, "node") == [("h",), ("s",)] and rows(met.frontier, "node") == [("g",)] and met.used == 3
    cut = expansion.level(frontier, spark.createDataFrame(WALK, NEIGHBOURS), 1, 1, walked=frontier.select("node"))
    assert rows(cut.expanded, "node") == [] and rows(cut.frontier, "node") == [("h",), ("lost",)] and cut.used == 1
    assert rows(cut.met, "key") == [("k1",), ("title:t",)]


def test_decisions_stay_in_the_batch_and_under_the_cap(spark):
    stored = spark.createDataFrame([("a", "s", "selected", True), ("b", "t", "selected", True)], "key string, scope string, decision string, exploratory boolean")
    batch = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    made = lambda *keys: spark.createDataFrame([(k, "selected", True) for k in keys], "key string, decision string, exploratory boolean")
    assert expansion.apply_decisions(stored, made("b"), batch, "s").count() == 3
    with pytest.raises(ValueError, match="exploratory_cap"):
        expansion.apply_decisions(stored, made("c", "d"), batch, "s")
    with pytest.raises(ValueError, match="outside_batch"):
        expansion.apply_decisions(stored, made("q"), batch, "s")


def test_works_that_share_a_doi_are_out_of_the_overlay(spark):
    works = spark.createDataFrame([("a", "10/A"), ("b", "10/b"), ("c", "10/c"), ("d", "10/C"), ("e", None)], "work string, doi string")
    records_ = spark.createDataFrame([("10/a", "W1"), ("10/B", "W2"), ("10/c", "W3")], "doi string, record string")
    refs = spark.createDataFrame([("W1", "W2"), ("W1", "W2"), ("W1", "W1"), ("W1", "W3")], "record string, cited string")
    assert rows(expansion.citation_overlay(works, records_, refs), "src", "dst") == [("a", "b")]


@pytest.mark.parametrize("few", [200, 1])
def test_quotes_are_found_folded_whole_and_short(spark, monkeypatch, few):
    monkeypatch.setattr(records, "FEW", few)
    quotes = spark.createDataFrame([(1, "Über-raschend, it is!"), (2, "ok"), (3, None), (4, "not there at all")], "quote_id int, quote string")
    sources = spark.createDataFrame([(1, "so uber\nraschend it IS here"), (2, "TOOL: tesseract OCR\nuberraschend it is ok"), (3, "o-k"), (4, None)], "source_id int, text string")
    assert rows(records.quotes_in_sources(quotes, sources), "quote_id", "source_id") == [(1, 1), (2, 3)]


def test_any_number_of_short_quotes(spark):
    draw = random.Random(4)
    quotes = [(i, "".join(draw.choices("abc-", k=draw.randrange(0, 16)))) for i in range(450)] + [(900, None), (901, "-")]
    sources = [(i, "".join(draw.choices("abcABC .", k=draw.randrange(0, 90)))) for i in range(40)] + [(99, None), (98, "TOOL: some OCR\nabc")]
    fold = lambda x: "".join(c for c in x.lower() if c.isalnum())
    want = sorted((q, s) for q, x in quotes if x is not None for s, y in sources if y is not None and s != 98 and fold(x) in fold(y))
    got = records.quotes_in_sources(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(sources, "source_id int, text string"))
    assert rows(got, "quote_id", "source_id") == want


def test_a_long_source_is_searched_once(spark):
    draw = random.Random(12)
    text = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=600_000))
    held = [text[i : i + 40] for i in range(0, 600_000, 3000)]
    quotes = [(i, q) for i, q in enumerate([*held, text[-12:], text[-5:], "-"])] + [(900, text[:40][::-1])]
    start = time.monotonic()
    got = records.quotes_in_sources(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame([(1, text), (1, "other"), (None, text[:60])], "source_id int, text string"))
    assert {tuple(r) for r in got.collect()} == {*((i, 1) for i in range(203)), (0, None), (202, None)}
    assert time.monotonic() - start < 60  # a gram at a time, each from the text's start, takes minutes


def test_receipts_and_cards_report_every_rule(spark):
    bad = spark.createDataFrame([("acquired", "mismatch", "odd", "/x", None, None), ("acquired", "verified", "ready", "a/b", "h", None)], "acquisition_status string, identity_status string, text_status string, staged_path string, sha256 string, quarantined boolean")
    got = bad.select(records.receipt_violations().alias("v"), records.claim_eligible().alias("ok")).collect()
    assert [(r.v, r.ok) for r in got] == [(["text_status", "staged_path", "no_sha256", "not_quarantined"], False), ([], True)]
    card = spark.createDataFrame([("A b", None, "s", "metadata", "full", 2)], "slug string, title string, source string, source_coverage string, read_depth string, n_claims int")
    assert card.select(records.card_violations()).first()[0] == ["slug", "identity", "claims_without_text", "depth_beyond_coverage"]


def test_passages_are_replaced_only_where_they_occur_once(spark):
    frame = spark.createDataFrame([("a b c", "b"), ("b b", "b"), ("a", "b"), ("a", ""), (None, "b")], "t string, p string")
    assert [r[0] for r in frame.select(records.replaced_passage(F.col("t"), F.col("p"), F.lit("X"))).collect()] == ["a X c", None, None, None, None]


def test_aliases_in_a_question_bring_their_concepts(spark):
    aliases = spark.createDataFrame([("Deep Nets", "neural"), ("net", "graph"), ("学习", "learning")], "alias string, slug string")
    assert retrieval.query_terms("How do deep nets help 机器学习?", aliases) == ["do", "deep", "nets", "help", "机器学习", "学习", "learning", "deep nets", "neural"]


def test_pages_that_nobody_marked_are_left_or_refused(spark):
    managed = spark.createDataFrame([("a", "1", True), ("b", "1", False), ("c", "1", True), ("d", "1", None), ("e", "2", True)], "path string, content string, marked boolean")
    current = spark.createDataFrame([("a", "1"), ("b", "1"), ("e", "3"), ("f", "1")], "path string, content string")
    assert rows(network.page_actions(managed, current), "path", "action") == [("a", "keep"), ("b", "refuse"), ("c", "delete"), ("e", "write"), ("f", "write")]


def test_fuzzy_titles_as_every_pair_by_sequence_matcher(spark):
    from difflib import SequenceMatcher

    from lodestar.functions.text import normal_title
    from lodestar.operators import identity

    titles = ["Deep learning for graphs", "Deep Learning, for graph", "deep-learning for GRAPHS", "A survey of deep learning", "Ünïcode title one", "ünïcode title  one!", "x", None, "", "..."]
    frame = spark.createDataFrame(list(enumerate(titles)), "k int, title string")
    tidy = {r.k: r.t for r in frame.select("k", normal_title("title").alias("t")).collect() if r.t}
    want = set()
    for a in tidy:
        for b in tidy:
            if a < b and max(SequenceMatcher(None, tidy[a], tidy[b]).ratio(), SequenceMatcher(None, tidy[b], tidy[a]).ratio()) >= 0.92:
                want.add((a, b))
    got = identity.similar_titles(frame, "k", "title")
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) >= 4
