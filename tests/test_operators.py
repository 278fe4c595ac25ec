"""Operators on small tables of their own."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import candidate_key, has_word, terms
from lodestar.operators import change, graph, identity, impact, ranking
from lodestar.plans import catalog


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_ancestors_of_a_diamond_and_a_cycle(spark):
    diamond = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")], "child string, parent string")
    assert rows(graph.ancestors(diamond).where("node = 'd'")) == [("d", "a"), ("d", "b"), ("d", "c")]
    cycle = spark.createDataFrame([("x", "y"), ("y", "x")], "child string, parent string")
    assert rows(graph.ancestors(cycle)) == [("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]


def test_page_is_honest(spark):
    items = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    assert [r.id for r in graph.page(items, "b", 2).collect()] == ["c", "d"]
    assert graph.page(items, None, 0).count() == 1
    with pytest.raises(ValueError, match="bad_cursor"):
        graph.page(items, "zz", 2)


def test_terms_and_words(spark):
    frame = spark.createDataFrame([("The mesh-free mesh and 图谱 图谱",)], "q string")
    assert frame.select(terms("q", ["the"])).first()[0] == ["mesh-free", "mesh", "and", "图谱"]
    found = frame.select(has_word(F.col("q"), "mesh"), has_word(F.col("q"), "mes"), has_word(F.col("q"), "图")).first()
    assert tuple(found) == (True, False, True)


def test_candidate_key_order(spark):
    frame = spark.createDataFrame([("10.1/X", None, "1", "T"), (None, "W1", "1", "T"), (None, None, None, "A  Title!"), (None, None, None, "--")], "d string, o string, a string, t string")
    keys = [r[0] for r in frame.select(candidate_key(F.col("d"), F.col("o"), F.col("a"), F.col("t"))).collect()]
    assert keys[:2] == ["doi:10.1/x", "openalex:w1"] and keys[2].startswith("title:") and keys[3] is None


def test_similar_titles_as_brute_force(spark):
    titles = ["deep learning for graphs", "deep learning for graph", "deep learning on graphs", "quantum fields", "quantum field", "a", "b", ""]
    frame = spark.createDataFrame(list(enumerate(titles)), "k long, t string")
    want = [(i, j) for i in range(8) for j in range(i + 1, 8) if titles[i] and titles[j] and SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.92]
    assert [(a, b) for a, b, _ in rows(identity.similar_titles(frame, "k", "t"))] == want


def test_title_classes_hold_every_similar_pair(spark):
    titles = ["deep learning for graphs", "deep learning for graph", "Deep, learning for graphs!", "quantum fields", "quantum field", "a", "b", "", None]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(titles * 3)] + [(None, "quantum fields")], "k long, t string")
    got = identity.title_classes(frame, "k", "t").collect()
    members = [(r.a, r.b) for r in got if r.kind == "member"]
    assert sorted(b for _, b in members) == [k for k in range(27) if titles[k % 9]]
    of = lambda c: [b for a, b in members if a == c]
    pairs = {(min(p), max(p), r.score) for r in got if r.kind == "similar" for p in [(x, y) for x in of(r.a) for y in of(r.b)]}
    pairs |= {(x, y, 1.0) for c, x in members for y in of(c) if x < y}
    assert pairs == {tuple(r) for r in identity.similar_titles(frame, "k", "t").collect()}


def test_fuzzy_titles_query_has_no_row_for_each_pair_of_copies(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    got = catalog.j13_fuzzy_titles(spark, "/root/testdata/sf0.001")
    assert got.where("kind = 'member'").count() == part.count()
    assert got.where("kind = 'similar'").count() <= part.select("p_name").distinct().count() ** 2 / 2


def test_round_robin_takes_each_lane_in_turn(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "z"), ("c", 1, "w")], "lane string, p int, k string")
    assert rows(ranking.round_robin(frame, "lane", "p", "k", 3)) == [("w", 2), ("x", 1), ("y", 3)]


def test_review_covers_what_came_before(spark):
    frame = spark.createDataFrame([(1, 1, "e"), (1, 2, "r"), (1, 3, "e"), (2, 1, "e"), (2, 2, "r"), (3, 1, "r")], "s int, t int, k string")
    state = change.update_state(frame, ["s"], ["t"], "k = 'e'", "k = 'r'")
    assert rows(state) == [(1, 2, 1, "pending"), (2, 1, 1, "resolved")]


def test_bands_at_their_bounds(spark):
    cases = [(90.0, None, False, False, 9), (89.9, "Q1", False, False, 9), (50.0, "Q2", False, False, 9), (10.0, "Q4", False, True, 1), (None, "Q1", True, False, 9), (None, None, False, True, 2)]
    frame = spark.createDataFrame(cases, "p double, q string, pre boolean, rev boolean, age int")
    got = [tuple(r[0]) for r in frame.select(impact.band(*[F.col(c) for c in ("p", "q", "pre", "rev", "age")])).collect()]
    assert got == [("high", "citations"), ("high", "venue"), ("medium", "citations"), ("medium", "floor"), (None, None), ("medium", "floor")]


def test_round_robin_reaches_past_repeated_keys(spark):
    rows = [(lane, 100 * n + i, 7) for n, lane in enumerate("ab") for i in range(20)]
    rows += [(lane, 100 * n + 50 + i, 10 * n + i) for n, lane in enumerate("ab") for i in range(3)]
    got = ranking.round_robin(spark.createDataFrame(rows, "lane string, place long, key long"), "lane", "place", "key", 5).orderBy("turn")
    assert [tuple(r) for r in got.collect()] == [(7, 1), (0, 2), (10, 3), (1, 4), (11, 5)]
