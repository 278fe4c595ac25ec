"""Quality classifier: a generalised additive model with pairwise interactions (operator 4).

One pass over the texts computes a short feature vector for each row.  Cyclic boosting of shallow
trees, one feature at a time and then one pair at a time, adds to lookup tables over binned features;
a score is the sum of table entries, added up for whole batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import unused

FEATURES = [
    "log_words", "log_chars", "chars_per_word", "longest_word", "unique_words", "unique_trigrams", "repeats",
    "upper_words", "upper_chars", "digit_chars", "space_chars", "punctuation_chars", "other_symbols", "bars",
    "marked_ends", "stop_ends", "lines_per_word", "unique_lines", "short_words", "byte_entropy", "top_word", "high_bytes",
]
#: Rows that the model is fitted on at most: those with the smallest hashes of their ids.
MAX_TRAIN = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES = 32, 120, 60, 8, 0.15, 4

_SPACE = [9, 10, 11, 12, 13, 32]
_PLAIN = [ord(c) for c in ".,;:'\"-()?"]
_SYMBOLS = [c for c in range(33, 127) if not chr(c).isalnum() and c not in _PLAIN]


def features(text: str | None) -> list[float]:
    """The numbers of ``FEATURES``; all 0 for a null or blank text."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = int(h.sum())
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    ends = "".join([w[-1] for w in words])
    lines = text.split("\n")
    p = h[h > 0] / size
    upper, letters = int(h[65:91].sum()), int(h[65:91].sum() + h[97:123].sum())
    trigrams = max(1, n - 2)
    return [
        math.log1p(n), math.log1p(size), size / n, min(100, max(map(len, kinds))), len(kinds) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / trigrams if n > 2 else 1.0,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n, upper / max(1, letters), int(h[48:58].sum()) / size, int(h[_SPACE].sum()) / size,
        int(h[_PLAIN].sum()) / size, int(h[_SYMBOLS].sum()) / size, int(h[124]) / n,
        1 - sum(map(str.isalnum, ends)) / n, (ends.count(".") + ends.count("?")) / n, len(lines) / n, len(set(lines)) / len(lines),
        sum(1 for w in words if len(w) < 4) / n, float(-(p * np.log2(p)).sum()), max(kinds.values()) / n, int(h[128:].sum()) / size,
    ]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: one vector for each row, from the whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            flat = np.array(rows, np.float32).ravel()
            ends = np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32) if rows else np.zeros(1, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "x"])

    return docs.select(id_col, text_col).mapInArrow(work, f"doc_id {docs.schema[id_col].dataType.simpleString()}, x array<float>")


@dataclass
class AdditiveModel:
    """Lookup tables: one for each feature, one for each chosen pair of features."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.single):
            out += table[bins[j]]
        rough = [self.coarse[j][b] for j, b in enumerate(bins)]
        for i, j, table in self.pairs:
            out += table[rough[i], rough[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a tree that cuts ordered bins into at most ``leaves`` intervals, best gain first."""
    spans, gain = [(0, len(g))], lambda a, b: a * a / (b + 1.0)
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(spans) < leaves:
        best = (1e-6, None, None)
        for s, (lo, hi) in enumerate(spans):
            if hi - lo < 2:
                continue
            cut = np.arange(lo + 1, hi)
            left, right = gain(G[cut] - G[lo], H[cut] - H[lo]), gain(G[hi] - G[cut], H[hi] - H[cut])
            more = left + right - gain(G[hi] - G[lo], H[hi] - H[lo])
            k = int(np.argmax(more))
            if more[k] > best[0]:
                best = (more[k], s, int(cut[k]))
        if best[1] is None:
            break
        lo, hi = spans.pop(best[1])
        spans += [(lo, best[2]), (best[2], hi)]
    step = np.zeros(len(g))
    for lo, hi in spans:
        step[lo:hi] = (G[hi] - G[lo]) / (H[hi] - H[lo] + 1.0)
    return step


def _square_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a table by one threshold on either axis: gain, and Newton steps of the four cells."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, step = 0.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            a = [G[i, j], G[i, -1] - G[i, j], G[-1, j] - G[i, j], G[-1, -1] - G[i, -1] - G[-1, j] + G[i, j]]
            b = [H[i, j], H[i, -1] - H[i, j], H[-1, j] - H[i, j], H[-1, -1] - H[i, -1] - H[-1, j] + H[i, j]]
            total = sum(x * x / (y + 5.0) for x, y in zip(a, b, strict=True))
            if total > best:
                best = total
                v = [x / (y + 5.0) for x, y in zip(a, b, strict=True)]
                step = np.zeros_like(g)
                step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = v
    return best, step


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost feature by feature in turn, then the pairs whose cut of the residuals gains most."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for c in x.T]
    coarse = [(np.arange(len(e) + 1) * 8 // (len(e) + 1)).astype(np.int64) for e in edges]
    model = AdditiveModel(edges, coarse, single=[np.zeros(len(e) + 1) for e in edges])
    if not len(x):
        return model
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(rate / (1 - rate)))
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    f = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            p = 1 / (1 + np.exp(-f))
            size = len(edges[j]) + 1
            step = RATE * _shallow_tree(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), LEAVES)
            model.single[j] += step
            f += step[b]
    rough = [c[b] for c, b in zip(coarse, bins, strict=True)]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        at = rough[i] * 8 + rough[j]
        return np.bincount(at, y - p, 64).reshape(8, 8), np.bincount(at, p * (1 - p), 64).reshape(8, 8)

    gains = sorted(((_square_tree(*cells(i, j))[0], i, j) for i in range(len(bins)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((8, 8))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * _square_tree(*cells(i, j))[1]
            table += step
            f += step[rough[i], rough[j]]
    return model


def held_out(id_col: str = "doc_id", of: int = 3, rest: int = 1) -> Column:
    """True where crc32 of the id's decimal text leaves the given rest; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(of)) == rest


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on labelled rows outside the held-out third; null labels, and ids with several labels, teach nothing.

    At most ``max_train`` labelled ids, chosen by a hash of the id, are broadcast to pick texts, and as
    many feature vectors reach the driver.
    """
    told = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    told = told.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select("doc_id", "y")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(told.select("doc_id")), "doc_id")
    rows = feature_table(texts).join(F.broadcast(told), "doc_id").select("x", "y").orderBy("x", "y").limit(max_train).toPandas()
    return fit(np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy(np.float64))


def with_scores(docs: DataFrame, model: AdditiveModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row under ``name``; a column of that name is replaced."""
    docs = docs.select([c for c in docs.columns if c != name])
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)], np.float64).reshape(-1, len(FEATURES)).astype(np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, name])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts get the score of an empty feature vector; repeated rows stay; without any
    usable label every score is 0.5.  Only the text is an input of a score.
    """
    model = train(docs, labels, max_train, id_col, text_col)
    scored = with_scores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` predicted good, with their own columns as they are; a model without labels rejects nothing."""
    name = unused("score", *docs.columns)
    return with_scores(docs, train(docs, labels, max_train), name=name).where(F.col(name) >= 0.5).select(docs.columns)
