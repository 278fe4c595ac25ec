"""The incremental index, the streamed log, skewed rankings, bundles and projects at their edges."""

import random

import pytest
from pyspark.sql import functions as F
from test_vault import FILES

from lodestar.operators import bundle, evidence, graph, impact, network, port, ranking, scopes, validators
from lodestar.sources import providers
from lodestar.sources.index import VaultIndex, difference, evidence_updates, near_titles, record_reviews, record_updates, shared_identifiers
from lodestar.sources.projects import Projects
from lodestar.sources.vault import CardTable
from lodestar.sources.vault_graph import VaultGraph
from lodestar.sources.versions import KeyedTable
from lodestar.streaming import updates


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def cards(spark, **changed):
    files = {k: v for k, v in (FILES | {k.replace("__", "/") + ".md": v for k, v in changed.items()}).items() if v is not None}
    return CardTable(spark.createDataFrame(list(files.items()), "path string, text string"))


def test_an_edited_card_rewrites_its_part(spark, tmp_path):
    index = VaultIndex(spark, f"file://{tmp_path}/i", parts=8)
    vault = cards(spark)
    assert index.freshness(vault) == "absent"
    index.refresh(vault)
    whole = VaultGraph(vault)
    assert rows(VaultGraph(index.at()).edges()) == rows(whole.edges()) and rows(VaultGraph(index.at()).unresolved()) == rows(whole.unresolved())
    assert rows(index.at().problems()) == rows(vault.problems())
    assert index.freshness(vault) == "fresh" and index.refresh(vault) == [] and index.at().told["version"] == 1

    later = cards(spark, papers__two="---\ntitle: Two\ntask: [flow]\n---\n- C1: text — p.1\n")
    assert index.freshness(later) == "stale"
    again = index.refresh(later)
    assert len(again) == 1
    before, after = index.at(1).told["files"], index.at(2).told["files"]
    assert {(t, p) for t in after for p in after[t] if after[t][p] != before[t].get(p)} <= {(t, str(again[0])) for t in after}
    assert rows(VaultGraph(index.at()).edges()) == rows(VaultGraph(later).edges())
    told = rows(difference(index.at(1), index.at(2)), "part", "id", "change")
    assert ("edges", "work:two|tag:task|concept:flow", "added") in told and ("nodes", "work:two", "changed") in told and not any("one" in t[1] for t in told)


def test_cards_and_registries_come_and_go(spark, tmp_path):
    index = VaultIndex(spark, f"file://{tmp_path}/i", parts=4)
    index.refresh(cards(spark))
    gone = FILES | {"domains.md": "| seas | Seas |\n"}
    gone.pop("papers/one.md")
    left = CardTable(spark.createDataFrame(list(gone.items()), "path string, text string"))
    assert len(index.refresh(left)) == 1
    assert rows(index.at().works(), "slug") == rows(left.works(), "slug") and rows(index.at().domains(), "slug") == [("seas",)]
    assert index.refresh(cards(spark)) and rows(index.at().claims(), "claim") == rows(cards(spark).claims(), "claim")
    assert index.prune(1) and rows(index.at().works(), "slug") == rows(cards(spark).works(), "slug")


def test_new_cards_are_confirmed_against_the_stored(spark, tmp_path):
    index = VaultIndex(spark, f"file://{tmp_path}/i", parts=64)
    index.refresh(cards(spark, papers__old='---\ntitle: "Echo in long dark tunnels"\nsource: "arXiv:2001.01234"\n---\n'))
    fresh = index.refresh(cards(spark, papers__old='---\ntitle: "Echo in long dark tunnels"\nsource: "arXiv:2001.01234"\n---\n', papers__new='---\ntitle: "Echo in long dark tunnel"\nsource: "doi 10.5555/FLOW.1"\n---\n'))
    assert rows(shared_identifiers(index.at(), fresh)) == [("doi", "10.5555/flow.1", "new", "one")]
    assert rows(near_titles(index.at(), fresh), "a", "b") == [("new", "old")]


RESTING = {
    "papers/p.md": "---\ntitle: P\n---\n- C1: quote — p.1\n", "gaps/g.md": "---\nstatus: live\nconcepts: [flow]\n---\n## Synthesis\n| S1 | st | claim:p#C1 | - | why |\n",
    "briefs/b.md": "---\ntopic: x\n---\n## Synthesis\n| B1 | st | - | gap:g | why |\n", "transfers/t.md": "---\na: flow\nc: lakes\n---\n## Synthesis\n| T1 | st | claim:p#C1 | - | why |\n",
    "papers/q.md": "---\ntitle: Q\n---\n- C1: other — p.2\n", "concepts.md": FILES["concepts.md"], "domains.md": FILES["domains.md"],
}
RELATION = "\n## Evidence relations\n| C1 | {} | gap:g | system | direct_response | s | r |\n"


def test_an_edit_asks_for_reviews_and_later_evidence_reopens(spark, tmp_path):
    index, table = VaultIndex(spark, f"file://{tmp_path}/i", parts=4), KeyedTable(spark, f"file://{tmp_path}/t", ["node_id", "entry"], parts=2)

    def edit(**files):
        index.refresh(CardTable(spark.createDataFrame(list((RESTING | {k.replace("__", "/") + ".md": v for k, v in files.items()}).items()), "path string, text string")))
        version = index.at().told["version"]
        if version > 1:
            record_updates(table, evidence_updates(index.at(version - 1), index.at()))
        return {(r.node_id, r.entry): (r.n_events, r.n_reviewed, r.status, "; ".join(r.suggestions)) for r in table.read().collect()} if version > 1 else {}

    edit()
    question, fresh = "review whether to question the judgment", (0, 0, "unchanged", "")
    state = edit(papers__q=RESTING["papers/q.md"] + RELATION.format("disputes"))
    assert state == {("gap:g", "S1"): (1, 0, "pending", question), ("brief:b", "B1"): (1, 0, "pending", question), ("transfer:t", "T1"): fresh}
    reviews = spark.createDataFrame([("gap:g", "S1", "retain", "another setting"), ("brief:b", "B1", "retain", " "), ("transfer:t", "T1", "revise", "x")], "node_id string, entry string, decision string, note string")
    assert rows(record_reviews(table, reviews)) == [("brief:b", "B1", "invalid_review"), ("gap:g", "S1", "resolved"), ("transfer:t", "T1", "not_pending")]
    disputed = RESTING["papers/q.md"] + RELATION.format("disputes")
    state = edit(papers__q=disputed, papers__new="---\ntitle: N\n---\n")  # nothing that any judgment rests on
    assert state[("gap:g", "S1")] == (1, 1, "resolved", "") and state[("brief:b", "B1")] == (1, 0, "pending", question)
    state = edit(papers__q=RESTING["papers/q.md"] + RELATION.format("reframes"), papers__p="---\ntitle: P\n---\n- C1: quote, corrected — p.1\n", papers__new="---\ntitle: N\n---\n")
    removed, scope = "review judgment after evidence relation removal", "review scope and whether to narrow the judgment"
    assert state[("gap:g", "S1")] == (2, 1, "pending", f"{removed}; {scope}") and state[("brief:b", "B1")] == (2, 0, "pending", f"{removed}; {scope}; {question}")
    assert state[("transfer:t", "T1")] == (1, 0, "pending", "review changed evidence and applicability")


def test_an_event_between_reading_and_reviewing_is_not_covered(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["node_id", "entry"], parts=1)
    change = lambda said: spark.createDataFrame([("g", "S", 1, 0, True, said)], "node_id string, entry string, changed_nodes long, changed_edges long, affected boolean, suggestions string")
    record_updates(table, change("one"))
    merge = KeyedTable.merge

    def late(self, new, resolve=None, tries=10):
        monkeypatch.setattr(KeyedTable, "merge", merge)
        record_updates(table, change("two"))
        return merge(self, new, resolve, tries)

    monkeypatch.setattr(KeyedTable, "merge", late)
    record_reviews(table, spark.createDataFrame([("g", "S", "retain", "read")], "node_id string, entry string, decision string, note string"))
    assert rows(table.read()) == [("g", "S", 2, 1, "pending", ["one", "two"])]


LOG = f"node_id string, entry string, {evidence.LOG}"


def log_rows(n, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        review = draw.random() < 0.3
        out.append((f"n{draw.randrange(6)}", draw.choice("ab"), i, draw.random() < 0.6, draw.sample("stu", 2), draw.choice(["retain", "revise", "shrug"]) if review else None, draw.choice(["read", " ", None]) if review else None))
    return out


def plain_log(entries):
    state = {}
    for node, entry, _, affected, said, decision, note in sorted(entries, key=lambda e: e[2]):
        own = state.get((node, entry))
        if decision is None:
            own = state.setdefault((node, entry), [0, 0, set()])
            if affected:
                own[0] += 1
                own[2] |= set(said)
        elif own and decision in evidence.DECISIONS and (note or "").strip():
            own[1], own[2] = own[0], set()
    return sorted((k[0], k[1], n, r, "unchanged" if not n else "pending" if r < n else "resolved", "; ".join(sorted(s))) for k, (n, r, s) in state.items())


def test_the_log_in_one_batch(spark):
    for seed in (1, 2):
        entries = log_rows(120, seed)
        assert rows(evidence.reviewed_log(spark.createDataFrame(entries, LOG))) == sorted(plain_log(entries), key=str)
    assert evidence.reviewed_log(spark.createDataFrame([], LOG)).count() == 0


def test_the_stream_with_a_restart_is_the_batch(spark, tmp_path):
    entries, folder = log_rows(90, 3), tmp_path / "log"
    table = KeyedTable(spark, f"file://{tmp_path}/table", list(updates.KEYS), parts=2)

    def arrive(part, name):
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(f"{folder}/{name}")

    def follow():
        stream = spark.readStream.schema(spark.createDataFrame([], LOG).schema).option("recursiveFileLookup", "true").parquet(str(folder))
        updates.follow(stream, table, f"file://{tmp_path}/checkpoint").awaitTermination()

    arrive(entries[:30], "a")
    follow()
    assert rows(table.read()) == sorted(plain_log(entries[:30]), key=str)
    arrive(entries[30:70], "b")
    follow()  # another query on the same checkpoint: its state goes on
    arrive(entries[70:], "c")
    follow()
    assert rows(table.read()) == sorted(plain_log(entries), key=str) == sorted(rows(evidence.reviewed_log(spark.createDataFrame(entries, LOG))), key=str)
    version = table.version()
    follow()  # nothing new
    assert table.version() == version


def test_of_two_reviews_one_counts(spark):
    updates_ = spark.createDataFrame([("a", "e", 2, 0, "pending"), ("b", "e", 1, 1, "resolved")], "node_id string, entry string, n_events long, n_reviewed long, status string")
    reviews = spark.createDataFrame([("a", "e", "shrug", "x"), ("a", "e", "retain", "x"), ("a", "e", "revise", "y"), ("b", "e", "retain", "x")], "node_id string, entry string, decision string, note string")
    assert rows(evidence.resolve_updates(updates_, reviews)) == [("a", "e", 2, 2, "resolved", "resolved"), ("b", "e", 1, 1, "resolved", "not_pending")]


def test_round_robin_over_a_hot_lane(spark):
    draw = random.Random(7)
    items = [("hot", i, f"k{draw.randrange(40)}") for i in range(600)] + [(lane, i, f"k{draw.randrange(60)}") for lane in "abc" for i in range(7)]
    places, order = {}, []
    for turn in range(600):
        order += [(turn, lane, key) for lane, i, key in sorted(items) if i == turn]
    for turn, lane, key in sorted(order):
        places.setdefault(key, len(places) + 1)
    want = sorted((k, p) for k, p in places.items() if p <= 15)
    frame = spark.createDataFrame(items, "lane string, at int, key string").repartition(5)
    assert rows(ranking.round_robin(frame, "lane", "at", "key", 15), "key", "turn") == want


def test_numbers_of_a_group_over_many_ranges(spark):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("parent"), F.lpad(F.col("id").cast("string"), 5, "0").alias("child"))
    got = rows(scopes.children(frame.union(frame)), "parent", "child", "place")
    by = {}
    for parent, child in sorted((r.parent, r.child) for r in frame.collect()):
        by.setdefault(parent, []).append(child)
    assert got == sorted(((p, c, i) for p, cs in by.items() for i, c in enumerate(cs, 1)), key=str)
    nulls = ranking.numbered(spark.createDataFrame([(None, "b"), (None, "a"), ("x", "c")], "g string, i string"), ["g"], ["i"])
    assert rows(nulls) == [("x", "c", 1), (None, "a", 1), (None, "b", 2)]


def test_similar_nodes_with_a_neighbour_that_all_have(spark):
    draw = random.Random(8)
    links = {(f"n{i:03d}", "hub") for i in range(300)} | {(f"n{i:03d}", f"v{draw.randrange(150)}") for i in range(300) for _ in range(2)}
    edges = spark.createDataFrame(sorted(links), "src string, dst string")
    own = {}
    for s, v in links:
        own.setdefault(s, set()).add(v)
    for least in (2, 3):
        want = sorted((a, b, len(own[a] & own[b])) for a in own for b in own if a < b and len(own[a] & own[b]) >= least)
        assert rows(graph.similar_nodes(edges, least)) == rows(graph.similar_nodes(edges, least, hot=3)) == want


def test_closure_in_one_task_and_by_levels(spark):
    draw = random.Random(9)
    links = [(f"n{draw.randrange(40)}", f"n{draw.randrange(40)}") for _ in range(60)] + [(f"leaf{i}", f"n{draw.randrange(40)}") for i in range(50)]
    parents = spark.createDataFrame(links, "child string, parent string")
    assert rows(graph.ancestors(parents)) == rows(graph.ancestors(parents, at_once=0))


def test_bundle_pages_follow_to_the_reachable(spark, tmp_path):
    nodes = spark.createDataFrame([(f"work:{i:02d}", "work", "w") for i in range(7)] + [("domain:d", "domain", "d"), ("claim:c", "claim", "c"), ("transfer:t", "transfer", "t"), ("brief:alone", "brief", "b"), ("brief:far", "brief", "b"), ("claim:far", "claim", "c")], "id string, kind string, label string")
    parents = spark.createDataFrame([(f"work:{i:02d}", "domain:d") for i in range(7)] + [("claim:c", "work:00"), ("claim:far", "brief:far")], "child string, parent string")
    edges = spark.createDataFrame([("transfer-from", "transfer:t", "domain:d")], "kind string, src string, dst string")
    folder = f"file://{tmp_path}/b"
    bundle.write_bundle(bundle.bundle(nodes, parents, edges, nodes.select("id", F.lit("text").alias("text")), 3), folder)
    own = bundle.Bundle(spark, folder)
    start = nodes.where("kind in ('domain', 'work')").select(F.col("id").alias("node"))
    assert rows(own.table("levels"), "id") == rows(network.reachable(start, parents, edges), "node") and own.table("contents").count() == 10
    found, page = [], 0
    while True:
        got = own.page("children", "parent", "domain:d", page).collect()
        found += [r.child for r in got]
        if got[0].next_cursor is None:
            break
        assert got[0].next_cursor == got[-1].child
        page += 1
    assert found == [f"work:{i:02d}" for i in range(7)] and page == 2
    assert rows(own.siblings("work:01"), "child") == [("work:00",), ("work:02",)] and rows(own.page("levels", "level", None), "id") == [("claim:c",), ("transfer:t",)]
    assert port.Port(nodes, parents, edges).sizes().where("level = 'concept'").first().n == 0


def test_projects(spark):
    files = [
        ("p", "project.yaml", "slug: p\n# note\nkind: paper\nkind: other\nstyle_profile: plain\n"), ("p", "outline/brief.json", '{"style_profile": "a; b.md"}'), ("p", "materials/materials.json", '[{"id": "material:m", "path": "x", "kind": "data"}]'),
        ("p", "research.md", "## Synthesis\n| S1 | st | claim:a#C1, claim:b#C2 | gap:g | why |\n\n## Observations\n| O1 | material:m | S1 | supports | i |\n| O2 | material:x | S1 | questions | i |\n| O3 | material:m | S2 | supports | i |\n"),
        ("p", "sections/intro/r002.md", "x"), ("p", "sections/intro/r010.md", "y"), ("q", "project.yaml", "slug: q\n"), ("q", "materials/materials.json", "no json"),
    ]
    own = Projects(spark.createDataFrame(files, "project string, path string, text string"))
    assert rows(own.latest(), "project", "section", "n") == [("p", "intro", 10)]
    assert rows(own.feedback(), "observation", "problem") == [("O1", None), ("O2", "material"), ("O3", "judgment")]
    context = rows(own.context(spark.createDataFrame([("a", "be brief")], "style string, rules string")))
    assert ("p", "manifest", "kind", "paper") in context and ("p", "style", "a", "be brief") in context and ("p", "style", "b", "") in context and ("q", "manifest", "slug", "q") in context
    assert ("p", "feedback", "O1", "supports claim:a#C1 claim:b#C2 gap:g") in context


def test_records_without_fields_break_no_validator(spark):
    none = lambda schema: spark.createDataFrame([(1, *[None] * (schema.count(",")))], schema) if "<" not in schema else None
    assert rows(validators.request_problems(none("id int, session_id string, scope string, date string, hops int, max_candidates int, user_confirmed boolean")), "problem", "detail") == sorted([("missing", k) for k in ("session_id", "scope", "date")] + [("not one hop", ""), ("candidates out of bounds", ""), ("not confirmed", "")], key=str)
    assert ("path outside the project", "") in rows(validators.material_problems(none("id int, material string, path string, kind string, vault_claim_eligible boolean")), "problem", "detail")
    plan = spark.createDataFrame([(1, None, None, None)], "id int, sections array<struct<name:string,depends_on:array<string>>>, evidence array<struct<ref:string,quote:string,anchor:string>>, materials array<string>")
    assert rows(validators.brief_problems(plan), "problem") == [("no sections",)]
    idea = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None)], "id int, project_id string, dimensions array<string>, minimal_experiment string, falsifiers array<string>, supporting array<string>, opposing array<string>, closest_prior_work array<string>, novelty map<string,string>, external struct<session_id:string,scope:string,date:string,hops:int,max_candidates:int,user_confirmed:boolean>")
    assert rows(validators.assessment_problems(idea), "problem", "detail") == [("missing", "falsifiers"), ("missing", "minimal_experiment"), ("missing", "project_id"), ("no dimension selected", "")]


def test_refresh_keeps_what_has_no_answer(spark):
    works = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "9")], "work string, ref string")
    records = spark.createDataFrame([("1", "new", None), ("2", None, "timeout")], "ref string, title string, error string")
    old = spark.createDataFrame([("a", "old"), ("b", "old"), ("z", "old")], "work string, title string")
    assert rows(impact.refreshed(old, works, records)) == [("a", "new"), ("b", "old"), ("z", "old")]
    assert rows(impact.refresh_buckets(works, records, True)) == [("a", "updated", None), ("b", "errors", "timeout"), ("c", "no_data", "no_identifier"), ("d", "errors", "cache_miss")]
    assert rows(impact.refresh_buckets(works, records)) == [("a", "updated", None), ("b", "no_data", "timeout"), ("c", "no_data", "no_identifier"), ("d", "no_data", "cache_miss")]


def test_staleness_changes_one_line(spark):
    pages = [
        ("a", "---\nsnapshot_id: s1\nstale: false\nstale: x\n---\nstale: body\n"), ("b", "---\nsnapshot_id: s0\n---\nx"), ("c", "---\r\nsnapshot_id: s1\r\n---\r\nbody\r\n"), ("d", "no matter"), ("e", "---\ntopic: x\n---\n"), ("f", "---\nsnapshot_id: s0\nstale: true\n---"),
    ]
    assert rows(network.flipped_briefs(spark.createDataFrame(pages, "path string, text string"), "s0")) == [
        ("a", "---\nsnapshot_id: s1\nstale: true\nstale: x\n---\nstale: body\n"), ("c", "---\r\nsnapshot_id: s1\r\nstale: true\r\n---\r\nbody\r\n"), ("f", "---\nsnapshot_id: s0\nstale: false\n---"),
    ]


@pytest.mark.parametrize("provider", sorted(providers.READERS))
def test_searches_that_say_nothing(spark, provider):
    frame = spark.createDataFrame([("<feed/>" if provider == "arxiv" else "{}",), (None,)], "p string").select(providers.search(provider, F.col("p")).alias("r"), providers.search_address(provider, F.lit("red echo"), 99).alias("url"))
    assert all(not r.r and "red+echo" in r.url and "=50" in r.url for r in frame.collect())
    if provider != "arxiv":
        assert frame.sparkSession.createDataFrame([("{}",)], "p string").select(providers.cited_by(provider, F.col("p")).alias("c")).first().c["items"] == []
    else:
        with pytest.raises(ValueError):
            providers.cited_by(provider, F.col("p"))
