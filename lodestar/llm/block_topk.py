"""Exact top-k inner products by block-at-a-time pruning (operator 10).

Vectors of whole numbers lie in ranges of like vectors; a block keeps each term's largest and smallest
value and its vectors as a forward index.  A query's bound on a block sums the larger product of each
term; blocks are scored from the highest bound down, until bounds fall below the query's k-th score.
Blocks of queries meet blocks of vectors; each meeting keeps k results a query, which are then merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .vectors import best_of, meetings, pack_blocks, usable

SCALE, K = 256, 5
#: Vectors in one task's range, queries in one block of queries, vectors in a block with bounds.
RANGE, QUERIES, BLOCK = 8192, 1024, 64
_EXACT = float(2**53)


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x)."""
    return np.floor(scale * x)


def arrange(x: np.ndarray) -> np.ndarray:
    """An order in which neighbours are alike: halved again and again along the direction of most spread."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK:
            out.append(at)
            continue
        c = x[at] - x[at].mean(0)
        d = c[np.argmax((c * c).sum(1))]
        for _ in range(3):
            d = c.T @ (c @ d)
            d = d / (np.abs(d).max() or 1)
        order = np.argsort(c @ d, kind="stable")
        half = max(BLOCK, len(at) // 2 // BLOCK * BLOCK)
        todo += [at[order[half:]], at[order[:half]]]
    return np.concatenate(out) if out else np.arange(0)


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``query, id, score`` of each query's k best in a range; equal scores go to smaller ids; its own id is left out."""
    if not len(ids) or not len(query_ids):
        return []
    with np.errstate(over="ignore"):
        exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < _EXACT
    if not exact:  # beyond doubles: Python's own integers
        wide_x, wide_q = [[int(v) for v in r] for r in x], [[int(v) for v in r] for r in q]
        out = []
        for i, r in zip(query_ids, wide_q, strict=True):
            scored = sorted((-sum(a * b for a, b in zip(r, v, strict=True)), int(j)) for j, v in zip(ids, wide_x, strict=True) if j != i)
            out += [(int(i), j, -s) for s, j in scored[:k]]
        return out
    order = arrange(x)
    ids, x = ids[order], x[order]
    starts = np.arange(0, len(ids), BLOCK)
    top, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    visit = np.argsort(-bound, axis=1, kind="stable")
    scores, owners = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    live = np.arange(len(q))
    for turn in range(len(starts)):
        block = visit[live, turn]
        going = bound[live, block] >= scores[live, -1]  # an equal score may still win by its id
        live, block = live[going], block[going]
        if not len(live):
            break
        for b in np.unique(block):
            mine = live[block == b]
            own = ids[starts[b] : starts[b] + BLOCK]
            s = q[mine] @ x[starts[b] : starts[b] + BLOCK].T
            s[own[None, :] == query_ids[mine][:, None]] = -np.inf
            s = np.concatenate([scores[mine], s], axis=1)
            o = np.concatenate([owners[mine], np.broadcast_to(own, (len(mine), len(own)))], axis=1)
            best = np.lexsort((o, -s), axis=1)[:, :k]
            scores[mine], owners[mine] = np.take_along_axis(s, best, 1), np.take_along_axis(o, best, 1)
    good = np.isfinite(scores)
    who = np.repeat(query_ids, k).reshape(scores.shape)
    return list(zip(who[good].tolist(), owners[good].tolist(), scores[good].astype(np.int64).tolist(), strict=True))


def top_products(table: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but those of the
    query's own id.  Vectors null or with null or non-finite components take no part; vectors of
    different dimensions never meet.  A repeated row counts once.
    """
    rows = materialize(usable(table, id_col, vector_col).distinct(), "vectors")
    ranges = pack_blocks(rows, RANGE, "ranges", whole)
    asked = pack_blocks(rows.where(F.col("vec_id") % every == 0), QUERIES, "queries", whole)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, own = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                x, q = np.frombuffer(r["x"], "<f8").reshape(-1, r["size"]), np.frombuffer(r["q_x"], "<f8").reshape(-1, r["size"])
                found = search(ids, x, own, q, k)
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    found = meetings(ranges, asked).mapInArrow(work, "query_id long, vec_id long, score long")
    return best_of(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k, F.desc("score"))
