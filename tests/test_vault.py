from pathlib import Path

import pytest

from lodestar.sources.vault import CardTable, Vault

FILES = {
    "domains.md": "# Domains\n\n| Slug | Name | Status |\n|---|---|---|\n| rivers | Rivers | live |\n| lakes | Lakes | live |\n| rivers | Running water | live |\n",
    "concepts.md": "# Concepts\n| stray | - | x |\n\n## task\n| Slug | Parents | Status | Aliases |\n|---|---|---|---|\n| flow | rivers | canonical | stream, current |\n| depth | rivers, lakes | canonical | - |\n| flow | lakes | late | - |\n\n## pattern\n| bed | - | canonical |\n",
    "papers/INDEX.md": "---\nslug: INDEX\n---\n",
    "papers/one.md": (
        '---\nslug: one\ntitle: "On flow"\n# a comment\nyear: 2020\nsource: "see https://doi.org/10.5555/Flow.1. and arXiv:2001.01234"\ndomain: [rivers]\ntask: ["flow", depth]\n'
        'pattern: bed\ngaps: ["g-one:supports", "a:b:disputes", bad, "x:wrong"]\ntitle: again\nno key here\n---\n'
        "# On flow\n\n## Claims\n\n- C1 [flow, depth]: \"Fast — and\n  deep\nstop\n  not this\" — p. 3\n- C2: a quote — with — dashes — p.4\n- C3: no anchor\n- Retraction of C2 (2024-01-02): wrong\n  work\n- Retraction of C9 (2024-01-02): none\n"
        "\n## Study profile\n\n<!-- note -->\n- method: C1, C2\n- method: C3\nnonsense\n\n## Argument\n| Role | Claim | Paraphrase | Attribution | Scope |\n|---|:-:|---|---|---|\n| problem | C1 | a \\| b | author | all |\n| villain | C1 | x | author | all |\n| advance | C1 | x | author |\n| advance |  | x | author | all |\n"
        "\n## Evidence relations\n| C1 | overlaps | gap:g-one | author | retrospective | s | r |\n| C1 | overlaps | gap:g-one | system | retrospective | s | r |\n"
    ),
    "papers/two.md": "no front matter\n- C1: text — p.1\n- C1: other — p.2\n",
    "papers/three.md": "---\nslug: other\ntitle: open\n",
    "papers/four.md": "\n",
    "papers/deep/er.md": "---\nslug: er\n---\n",
    "gaps/g-one.md": "---\ntype: open\nstatus: live\nconcepts: [flow, unknown]\nrelated: [g-two]\n---\nText\nof it\n\n## Synthesis\n| ID | Statement | Claims | Gaps | Rationale |\n|---|---|---|---|---|\n| s1 | st | one#C1 | - | why |\n",
    "transfers/t.md": "---\na: flow\nc: lakes\nbridges: [bed]\npapers: [one]\ngaps: []\nstatus: idea\n---\n",
    "briefs/2024-05-06-water.md": "---\ndomain: rivers\nother: x\n---\nBody\n",
    "briefs/2024-05-07-plain.md": "Body only\n",
}


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("a vault+é")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text, encoding="utf-8")
    return Vault(spark, str(top))


def by(df, key):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


def test_works(vault):
    works = by(vault.works(), "slug")
    assert set(works) == {"one", "two", "three", "four"}
    one = works["one"]
    assert (one["title"], one["year"], one["doi"], one["arxiv"]) == ("On flow", "2020", "10.5555/flow.1", "2001.01234")
    assert (one["domain"], one["task"], one["pattern"], one["failure_mode"]) == (["rivers"], ["flow", "depth"], [], [])
    assert one["gaps"] == [{"gap": "g-one", "relation": "supports"}, {"gap": "a:b", "relation": "disputes"}]
    assert one["read_depth"] == "not-recorded" and works["two"]["title"] == "two" and works["three"]["title"] == "three"


def test_claims(vault):
    claims = by(vault.claims(), "claim")
    assert set(claims) == {"one#C1", "one#C2", "one#C3", "two#C1"}
    assert claims["one#C1"]["quote"] == '"Fast' and claims["one#C1"]["anchor"] == "and deep"
    assert claims["one#C1"]["concepts"] == ["flow", "depth"] and claims["one#C1"]["retracted"] is None
    assert claims["one#C2"]["quote"] == "a quote — with — dashes" and claims["one#C2"]["anchor"] == "p.4"
    assert claims["one#C2"]["retracted"] == {"date": "2024-01-02", "note": "wrong work"}
    assert claims["one#C3"]["anchor"] is None and claims["two#C1"]["quote"] == "other"


def test_registries(vault):
    concepts = by(vault.concepts(), "slug")
    assert set(concepts) == {"flow", "depth", "bed"}
    assert concepts["flow"] == {"slug": "flow", "axis": "task", "parents": ["rivers"], "status": "canonical", "aliases": ["stream", "current"]}
    assert concepts["bed"]["parents"] == [] and concepts["bed"]["axis"] == "pattern" and concepts["depth"]["aliases"] == ["-"]
    assert {s: r["name"] for s, r in by(vault.domains(), "slug").items()} == {"rivers": "Running water", "lakes": "Lakes"}


def test_other_cards_and_tables(vault):
    assert by(vault.gaps(), "slug")["g-one"]["text"].startswith("Text\nof it")
    assert by(vault.transfers(), "slug")["t"]["bridges"] == ["bed"]
    briefs = by(vault.briefs(), "slug")
    assert (briefs["2024-05-06-water"]["topic"], briefs["2024-05-06-water"]["date"]) == ("rivers", "2024-05-06")
    assert briefs["2024-05-07-plain"]["topic"] == ""
    assert [(r.role, r.claims) for r in vault.profiles().collect()] == [("method", ["C1", "C2"])]
    assert [(r.role, r.paraphrase) for r in vault.table("Argument").collect()] == [("problem", "a | b")]
    assert [r.attribution for r in vault.table("Evidence relations").collect()] == ["system"]
    assert [(r.card, r.claims) for r in vault.table("Synthesis").collect()] == [("g-one", "one#C1")]


def test_problems(vault):
    found = sorted((r.origin, r.problem) for r in vault.problems().collect())
    one = "papers/one.md"
    assert found == sorted([
        ("concepts.md", "repeated slug"), (one, "repeated key"), (one, "unparseable line"), (one, "list expected"), (one, "bad gap entry"), (one, "bad gap entry"),
        (one, "claim without anchor"), (one, "retraction of no claim"), (one, "repeated role"), (one, "bad profile line"), (one, "unknown argument role"),
        (one, "wrong number of cells"), (one, "empty cell"), (one, "retrospective relation not by system"), ("papers/two.md", "no front matter"),
        ("papers/two.md", "repeated claim"), ("papers/three.md", "front matter not closed"), ("papers/four.md", "no front matter"),
    ])


def test_fingerprint(vault, spark, tmp_path):
    def of(files):
        top = tmp_path / str(len(list(tmp_path.iterdir())))
        for name, text in files.items():
            (top / name).parent.mkdir(parents=True, exist_ok=True)
            (top / name).write_text(text, encoding="utf-8")
        return Vault(spark, str(top)).fingerprint().first()[0]

    assert vault.fingerprint().first()[0] == of(FILES)
    swapped = FILES | {"papers/one.md": FILES["papers/two.md"], "papers/two.md": FILES["papers/one.md"]}
    assert len({of(FILES), of(swapped), of(FILES | {"papers/new.md": "x"}), of({k: v for k, v in FILES.items() if k != "papers/deep/er.md"})}) == 4
    rows = spark.createDataFrame(list(FILES.items()), "path string, text string")
    assert CardTable(rows.repartition(5)).fingerprint().first()[0] == of(FILES)


def test_cards_in_a_table_are_read_like_files(vault, spark):
    table = CardTable(spark.createDataFrame(list(FILES.items()), "path string, text string"))
    for name in ("works", "claims", "gaps", "transfers", "briefs", "profiles", "concepts", "domains", "problems"):
        assert sorted(map(str, getattr(table, name)().collect())) == sorted(map(str, getattr(vault, name)().collect())), name
    only = spark.createDataFrame([("papers/one.md",)], "path string")
    assert [r.slug for r in table.within(only).works().collect()] == ["one"] == [r.slug for r in vault.within(only).works().collect()]
    assert table.within(only).concepts().count() == 3 and table.within(only).gaps().count() == 0


def test_nothing_there(spark, tmp_path):
    empty = Vault(spark, str(tmp_path))
    assert empty.works().count() == empty.claims().count() == empty.concepts().count() == 0
    assert [(r.origin, r.problem) for r in empty.problems().collect()] == [("domains.md", "no rows")]
