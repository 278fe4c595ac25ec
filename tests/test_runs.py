"""Versioned tables with several writers, and expansion runs whose driver is lost."""

import pytest
from test_evidence import NEIGHBOURS, WALK

from lodestar.operators.runs import ExpansionRun, Pool
from lodestar.sources import versions
from lodestar.sources.versions import Conflict, KeyedTable

STATE = "node string, entry string, status string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def state(spark, *items):
    return spark.createDataFrame(list(items), STATE)


def test_a_merge_replaces_keys_and_touches_their_parts_only(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["node", "entry"], parts=8)
    assert table.read() is None and table.version() == 0
    table.merge(state(spark, *[(f"n{i}", "e", "old") for i in range(100)]))
    before = table.manifest()["parts"]
    touched = table.merge(state(spark, ("n7", "e", "new"), ("n7", "f", "new")))
    after = table.manifest()["parts"]
    assert {int(p) for p in after if after[p] != before.get(p)} == set(touched) and len(touched) <= 2
    assert rows(table.read().where("status = 'new'"), "node", "entry") == [("n7", "e"), ("n7", "f")] and table.read().count() == 101
    assert table.read(1).count() == 100 and table.read(1).where("status = 'new'").isEmpty()
    assert table.merge(state(spark)) == [] and table.version() == 2
    with pytest.raises(ValueError, match="repeated_keys"):
        table.merge(state(spark, ("a", "b", "x"), ("a", "b", "y")))


def test_null_keys_are_keys(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["node", "entry"], parts=4)
    table.merge(state(spark, (None, "e", "old"), ("n", None, "old")))
    table.merge(state(spark, (None, "e", "new")))
    assert sorted(map(str, (tuple(r) for r in table.read().collect()))) == ["('n', None, 'old')", "(None, 'e', 'new')"]


def test_two_writers_lose_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    one, two = (KeyedTable(spark, folder, ["node", "entry"], parts=4) for _ in range(2))
    one.merge(state(spark, ("a", "e", "old"), ("b", "e", "old")))
    calls = []

    def meanwhile(old, new):
        """The other writer commits between this one's read and its publication, once."""
        if not calls:
            calls.append(two.merge(state(spark, ("a", "e", "reviewed by two"), ("c", "e", "from two"))))
        return versions.newer_wins(["node", "entry"])(old, new)

    one.merge(state(spark, ("b", "e", "reviewed by one"), ("d", "e", "from one")), meanwhile)
    assert rows(one.read(), "node", "status") == [("a", "reviewed by two"), ("b", "reviewed by one"), ("c", "from two"), ("d", "from one")]
    assert one.version() == 3


def test_a_reader_keeps_its_version_until_it_is_pruned(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["node", "entry"], parts=2)
    for i in range(4):
        table.merge(state(spark, ("a", "e", f"v{i}")))
    held = table.read(2)
    assert rows(held, "status") == [("v1",)] and rows(table.read(), "status") == [("v3",)]
    gone = table.prune(keep=1)
    assert len(gone) == 3 and rows(table.read(), "status") == [("v3",)] and table.version() == 4


def test_a_version_is_published_once(spark, tmp_path):
    versions.publish(spark, f"file://{tmp_path}/v", {"who": 1}, 1)
    with pytest.raises(Conflict):
        versions.publish(spark, f"file://{tmp_path}/v", {"who": 2}, 1)
    assert versions.newest(spark, f"file://{tmp_path}/v") == {"who": 1, "version": 1}


def world(spark):
    records = [(k, f"title of {k}", 2000, None if k.startswith("title") else k, None, None) for k in ("k1", "k2", "k3", "k4", "title:t")]
    return spark.createDataFrame(WALK, NEIGHBOURS), spark.createDataFrame(records, "key string, title string, year int, doi string, openalex string, arxiv string"), spark.createDataFrame([("s", 1)], "node string, seq int")


def told(run):
    return rows(run.found(), "kind", "item", "via", "direction", "depth", "at"), rows(run.warnings(), "warning"), rows(run.expanded(), "node"), rows(run.pool.candidates.read(), "key", "title", "verified"), rows(run.pool.occurrences.read(), "key", "via", "direction", "depth")


@pytest.mark.parametrize("lost_at", ["nothing", "written", "committed", "merged"])
def test_a_resumed_run_is_an_unbroken_one(spark, tmp_path, lost_at):
    near, records, seeds = world(spark)
    whole = ExpansionRun.start(spark, f"file://{tmp_path}/a", "r", "all", seeds, pool_parts=2)
    assert whole.execute(near, records) == "frontier_exhausted"
    state = f"file://{tmp_path}/b"
    run = ExpansionRun.start(spark, state, "r", "all", seeds, pool_parts=2)
    if lost_at == "written":
        run.write_level(near)
    if lost_at == "committed":
        run.step(near)  # and its candidates never reach the pool
    if lost_at == "merged":
        run.step(near, records)
    again = ExpansionRun.resume(spark, state, "r", records, pool_parts=2)
    again.execute(near, records)
    assert told(again) == told(whole)
    keys = [r.item for r in again.found().where("kind <> 'hit'").collect()]
    assert len(keys) == len(set(keys)) == 4
    assert not ExpansionRun.resume(spark, state, "r", pool_parts=2).step(near)


def test_runs_share_a_pool_and_their_ids_are_taken_once(spark, tmp_path):
    near, records, seeds = world(spark)
    state = f"file://{tmp_path}/s"
    first = ExpansionRun.start(spark, state, "one", "all", seeds, pool_parts=2)
    first.execute(near, records)
    with pytest.raises(Conflict):
        ExpansionRun.start(spark, state, "one", "all", seeds)
    second = ExpansionRun.start(spark, state, "two", "all", spark.createDataFrame([("h", 1), ("g", 2)], "node string, seq int"), pool_parts=2)
    second.execute(near, records)
    assert rows(second.found().where("kind = 'new'"), "item") == [("k4",)]
    assert rows(Pool(spark, state, 2).occurrences.read().where("key = 'k1'"), "run", "via") == [("one", "h"), ("one", "s"), ("two", "h")]


def test_reviews_stay_in_the_batch(spark, tmp_path):
    near, records, seeds = world(spark)
    run = ExpansionRun.start(spark, f"file://{tmp_path}/s", "r", "all", seeds, max_new=2, pool_parts=2)
    assert run.execute(near, records) == "budget_reached"
    made = lambda *keys: spark.createDataFrame([(k, "selected", True) for k in keys], "key string, decision string, exploratory boolean")
    with pytest.raises(ValueError, match="outside_batch"):
        run.apply_decisions(made("title:t"))
    run.apply_decisions(made("k1"))
    assert rows(run.review_batch(), "key", "title", "n_occurrences", "decision", "max_new", "used", "stop_reason") == [("k1", "title of k1", 1, "selected", 2, 2, "budget_reached"), ("k2", "title of k2", 1, None, 2, 2, "budget_reached")]


def test_what_a_run_refuses(spark, tmp_path):
    seeds = world(spark)[2]
    for wrong in ({"depth": 3}, {"max_new": 0}, {"max_new": 51}, {"scope": ""}, {"seeds": seeds.limit(0)}):
        with pytest.raises(ValueError):
            ExpansionRun.start(spark, f"file://{tmp_path}/s", **({"run_id": "r", "scope": "all", "seeds": seeds} | wrong))
    with pytest.raises(ValueError, match="unknown_run"):
        ExpansionRun.resume(spark, f"file://{tmp_path}/s", "none")
    run = ExpansionRun.start(spark, f"file://{tmp_path}/s", "r", "all", seeds)
    with pytest.raises(ValueError, match="stop_reason"):
        run.stop("tired")
    run.stop()
    assert ExpansionRun.resume(spark, f"file://{tmp_path}/s", "r").stopped == "user_stop"
