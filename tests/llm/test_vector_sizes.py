"""Nearest neighbours in tables of several dimensions, against all distances."""

import math
import random

import pytest

pytest.importorskip("lodestar.llm")
from lodestar.llm import hamming_index  # noqa: E402


def test_vectors_of_every_dimension_are_searched_among_their_own(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(3 if i % 2 else 8)]) for i in range(1, 19)] + [(100, [0.5] * 8), (200, [0.5] * 3), (300, [1.0]), (400, [2.0]), (500, [1.0, float("nan")]), (600, None), (700, [0.0] * 3)]
    rows += [(100, [0.5] * 8)]
    got = {}
    for r in hamming_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = {i: v for i, v in rows if v and all(map(math.isfinite, v)) and any(v)}
    for q in (100, 200, 300, 400):
        want = sorted((math.dist(good[q], v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:10]
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert [s for _, s in got[q]] == pytest.approx([d for d, _ in want])
    assert set(got) == {100, 200, 300, 400}
