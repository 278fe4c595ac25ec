"""The Jaccard join against brute force: null ids, large groups of near copies, bounds that keep groups closed, hostile names."""

import random

import numpy as np
import pytest

pytest.importorskip("lodestar.llm")
from lodestar.llm import jaccard  # noqa: E402


def words_of(draw, n):
    return ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(3, 9))) for _ in range(n)]


def classes(texts, width, p, q):
    """The least place of each text's component, from all pairs."""
    sets, root = jaccard.shingle_sets(texts, width), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = jaccard.overlap(a, b)
            if len(a) and q * both >= p * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_a_near_copy_without_an_id_links(spark):
    draw = random.Random(1)
    base = words_of(draw, 120)
    near = [*base[:60], "changed", *base[61:]]
    far = words_of(draw, 120)
    docs = spark.createDataFrame([(None, " ".join(near)), (7, " ".join(base)), (9, " ".join(far)), (None, " ".join(near))], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard.jaccard_components(docs, 3, (9, 10)).collect())
    assert got == [(0, 7), (0, 7), (7, 7), (9, 9)]
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs, 3, (9, 10)).collect()) == [7, 9]


@pytest.mark.parametrize(("width", "p", "q", "changes"), [(3, 9, 10, 4), (5, 4, 5, 5)])
def test_a_large_group_of_near_copies_as_brute_force(spark, width, p, q, changes):
    """Copies of one text with some words changed: many are over the similarity to the base and under it to each other."""
    draw = random.Random(width)
    base, texts = words_of(draw, 100), []
    for _ in range(500):
        own = list(base)
        for _ in range(draw.randrange(changes + 1)):
            own[draw.randrange(100)] = words_of(draw, 1)[0]
        texts.append(" ".join(own))
    texts += [" ".join(words_of(draw, 60) + base[:40]) for _ in range(60)]  # a shared passage links nothing
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, width, (p, q)).collect()}
    want = classes(texts, width, p, q)
    assert [got[i] for i in range(len(texts))] == want
    kept = sorted(r.doc_id for r in jaccard.one_of_each(docs, width, (p, q)).collect())
    assert kept == sorted(set(want))


def test_rows_that_share_an_id_are_told_apart(spark):
    draw = random.Random(4)
    one, two = " ".join(words_of(draw, 50)), " ".join(words_of(draw, 50))
    docs = spark.createDataFrame([(1, one, 0), (1, two, 1), (1, one, 2), (2, "", 3), (2, "", 4), (3, None, 5)], "doc_id long, text string, digest int")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == ["doc_id", "text", "digest"]
    rows = kept.collect()
    assert sorted((r.doc_id, r.text) for r in rows if r.text) == sorted([(1, one), (1, two)])
    assert sum(not r.text for r in rows) == 3


def test_a_group_whose_union_cannot_reach_the_overlap_stays_closed():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 1 << 62, 50).astype(np.uint64)) for _ in range(4)]

    class Closed(jaccard.Group):
        def overlaps(self, s):
            raise AssertionError("opened")

    parts = ([1, 2], [50, 100], np.concatenate(sets[:2]).tobytes(), np.union1d(sets[0], sets[1]).tobytes())
    assert jaccard.linked_members(9, sets[2], Closed(*parts), (4, 5)) == []
    own = np.sort(np.concatenate([sets[0][:48], sets[3][:2]]))
    assert jaccard.linked_members(9, own, jaccard.Group(*parts), (4, 5)) == [1]


def test_tokens_that_no_other_set_has(spark):
    texts = ["a b c d e f", "a b c d x y", "q r s"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    lonely = {r.item: r.lonely for r in jaccard.lonely_tokens(frame, 3, 7).collect()}
    assert [lonely[jaccard.set_ids(s)] for s in jaccard.shingle_sets(texts, 3)] == [2, 2, 1]
