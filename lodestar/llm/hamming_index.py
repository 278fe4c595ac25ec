"""Approximate nearest neighbours by multi-index hashing (operator 9).

Vectors get binary codes under a rotation learnt on a bounded sample (principal axes, then iterative
quantisation).  Each range of vectors indexes its codes' substrings, one table for each substring.  A
code within Hamming radius R of the query's has a substring within R // m bits of the query's (one
bit less in all but the first R % m + 1 substrings), so probing those values retrieves every code
within R.  What is retrieved is ranked by exact distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .vectors import best_of, meetings, pack_blocks, usable

#: Vectors that rotation and radius are learnt from at most: those with the smallest hashes of their ids.
MAX_SAMPLE = 8_000
#: Share of the sample's own nearest neighbours that the radius must reach.
REACH = 0.97
TURNS, SUBSTRING, K = 30, 16, 10
RANGE, QUERIES = 8192, 1024

_ONES = np.array([bin(i).count("1") for i in range(1 << SUBSTRING)], np.uint8)


class Coder:
    """Codes of vectors, and the Hamming radius to search."""

    def __init__(self, sample: np.ndarray):
        self.mean = sample.mean(0)
        c = sample - self.mean
        _, axes = np.linalg.eigh(c.T @ c + 1e-12 * np.eye(c.shape[1]))
        axes = axes[:, ::-1][:, :64]
        v = c @ axes
        r, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((axes.shape[1],) * 2))
        for _ in range(TURNS):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.projection = axes @ r
        self.bits = axes.shape[1]
        self.radius = self._learn_radius(sample)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The substrings of each code, one column each."""
        signs = ((x - self.mean) @ self.projection >= 0).astype(np.int64)
        cut = [signs[:, lo : lo + SUBSTRING] for lo in range(0, self.bits, SUBSTRING)]
        return np.stack([c @ (1 << np.arange(c.shape[1])) for c in cut], axis=1)

    def _learn_radius(self, sample: np.ndarray) -> int:
        """The radius that holds ``REACH`` of the ``K`` nearest neighbours of some of the sample in the sample."""
        asked, codes, apart = sample[:256], self.codes(sample), []
        for i, q in enumerate(asked):
            d = ((sample - q) ** 2).sum(1)
            d[i] = np.inf
            near = np.argpartition(d, min(K, len(d) - 1))[:K]
            apart += _ONES[codes[near[np.isfinite(d[near])]] ^ codes[i]].sum(1).tolist()
        return int(np.quantile(apart, REACH, method="higher")) if apart else self.bits


class RangeIndex:
    """Substring tables of one range of vectors."""

    def __init__(self, coder: Coder, ids: np.ndarray, x: np.ndarray):
        self.coder, self.ids, self.x, self.codes = coder, ids, x, coder.codes(x)
        self.tables = []
        for column in self.codes.T:
            order = np.argsort(column, kind="stable")
            values, starts = np.unique(column[order], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all vectors whose code lies within ``radius`` of ``code``."""
        whole, extra = divmod(radius, len(self.tables))
        seen = np.zeros(len(self.ids), bool)
        for j, (values, starts, order) in enumerate(self.tables):
            reach = whole if j <= extra else whole - 1
            if reach < 0:
                continue
            hit = np.flatnonzero(_ONES[values ^ code[j]] <= reach)  # the values within reach that occur
            counts = starts[hit + 1] - starts[hit]
            at = np.repeat(starts[hit] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            seen[order[at]] = True
        found = np.flatnonzero(seen)
        return found[_ONES[self.codes[found] ^ code].sum(1, dtype=np.int64) <= radius]

    def nearest(self, query_id: int, q: np.ndarray, code: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """The ``k`` nearest retrieved; the radius grows while fewer are."""
        radius = self.coder.radius
        while True:
            found = self.probe(code, radius)
            found = found[self.ids[found] != query_id]
            if len(found) >= k or radius >= self.coder.bits:
                break
            radius = min(self.coder.bits, radius + 2)
        d = np.sqrt(((self.x[found] - q) ** 2).sum(1))
        best = np.lexsort((self.ids[found], d))[:k]
        return [(query_id, int(self.ids[found[i]]), float(d[i])) for i in best]


def nearest(table: DataFrame, every: int = 100, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest of those found, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but those of the
    query's own id.  ``score`` is the Euclidean distance in double precision.  Vectors null, zero, or
    with null or non-finite components take no part.  Vectors of each dimension are searched among their own,
    with codes of their own.  A repeated row counts once; fewer than ``k`` candidates are all returned.
    """
    rows = materialize(usable(table, id_col, vector_col, zero=False).distinct().withColumn("size", F.size("v")), "vectors")
    sizes = sorted(r["size"] for r in rows.select("size").distinct().collect())  # dimensions of embeddings, not rows
    parts = [_of_one_size(rows.where(F.col("size") == size).select("vec_id", "v"), size, every, k) for size in sizes]
    schema = "query_id long, vec_id long, score double"
    found = reduce(DataFrame.union, parts) if parts else table.sparkSession.createDataFrame([], schema)
    return best_of(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k, F.col("score"))


def _of_one_size(rows: DataFrame, size: int, every: int, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of what each range finds for each query among vectors of one dimension."""
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_SAMPLE).collect()]
    coder = Coder(np.array(sample))
    ranges = pack_blocks(rows, RANGE, "ranges")
    asked = pack_blocks(rows.where(F.col("vec_id") % every == 0), QUERIES, "queries")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                index = RangeIndex(coder, np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["x"], "<f8").reshape(-1, size))
                q = np.frombuffer(r["q_x"], "<f8").reshape(-1, size)
                codes = coder.codes(q)
                found = [f for i, own in enumerate(np.frombuffer(r["q_ids"], "<i8")) for f in index.nearest(int(own), q[i], codes[i], k)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return meetings(ranges, asked).mapInArrow(work, "query_id long, vec_id long, score double")
