"""Language ID by a linear-chain conditional random field over words (operator 7).

Every word has affix, character n-gram and lexicon features; transitions between the languages of
neighbouring words are learnt too, from lines and from joints of lines of two languages.  Forward and
backward passes give each word's posterior; a document's language has the largest mean posterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out

#: Documents learnt from at most (those with the smallest hashes of their ids), and windows of words drawn from them.
MAX_DOCS, MAX_WINDOWS = 1500, 6000
#: Words of a line that one chain spans; longer lines are cut into several chains, none is left out, and no transition crosses a cut.
WINDOW = 64
#: Characters of a text that are learnt from at most.
MAX_LEARNT = 20_000
EPOCHS, BATCH, STEP, DECAY, SWITCHED = 3, 256, 0.4, 1e-4, 0.3
#: Characters labelled at once, and words whose scores are remembered.
SLICE, REMEMBER = 1 << 20, 1_000_000
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def word_features(w: str) -> list[str]:
    """Lexicon entry, prefixes and suffixes up to 3, and inner character 2- and 3-grams."""
    b = f"^{w}$"
    n = len(b)
    return ["=" + w, *[b[:k] for k in (2, 3, 4) if k < n], *[b[-k:] for k in (2, 3, 4) if k < n], *["~" + b[i : i + 2] for i in range(1, n - 2)], *["~" + b[i : i + 3] for i in range(1, n - 3)]]


def windows_of(text: str) -> Iterator[list[str]]:
    """The words of each line, ``WINDOW`` at a time."""
    for line in text.lower().split("\n"):
        words = [w for w in _WORD.findall(line) if w.isalpha() or any(map(str.isalpha, w))]  # the pattern also takes numerals like a half
        for i in range(0, len(words), WINDOW):
            yield words[i : i + WINDOW]


def forward_backward(emission: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (chain, place, label) and expected transitions; chains are sorted from long to short."""
    chains, most, labels = emission.shape
    e = np.exp(emission - emission.max(2, keepdims=True))
    live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(most)]  # chains longer than t
    a, b = np.zeros_like(e), np.ones_like(e)
    a[:, 0] = start * e[:, 0]
    a[:, 0] /= a[:, 0].sum(1, keepdims=True)
    for t in range(1, most):
        n = live[t]
        step = (a[:n, t - 1] @ move) * e[:n, t]
        a[:n, t] = step / step.sum(1, keepdims=True)
    moves = np.zeros((labels, labels))
    for t in range(most - 1, 0, -1):
        n = live[t]
        tail = e[:n, t] * b[:n, t]
        back = tail @ move.T
        pair = np.einsum("ni,nj->nij", a[:n, t - 1], tail) * move
        moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        b[:n, t - 1] = back / back.sum(1, keepdims=True)
    p = a * b
    return p / np.maximum(p.sum(2, keepdims=True), 1e-300), moves


@dataclass
class Chain:
    """Weights of features and transitions; ``remembered`` holds scores of words already seen in a worker."""

    labels: list[str]
    rows: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    remembered: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def word_ids(self, words: list[str]) -> np.ndarray:
        known, rows = self.remembered, self.rows
        if len(known) > REMEMBER:
            known.clear()
        ids = [known.get(w, -1) for w in words]
        if -1 in ids:
            for i, w in enumerate(words):
                if ids[i] < 0:
                    if (k := known.get(w)) is None:
                        k = known[w] = len(known)
                        if k >= len(self.scores):  # doubled, so that words cost the same however many came before
                            self.scores = np.vstack([self.scores.reshape(-1, len(self.labels)), np.zeros((max(1024, k), len(self.labels)))])
                        at = [r for f in word_features(w) if (r := rows.get(f)) is not None]
                        self.scores[k] = np.add.reduce(self.weights[at]) if at else 0
                    ids[i] = k
        return np.array(ids, np.int64)

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """``language, share`` of each text; no letters: undetermined, 0."""
        chains: list[list[str]] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            for words in windows_of(t) if t else ():
                chains.append(words)
                owner.append(i)
        total = np.zeros((len(texts), len(self.labels)))
        if chains and self.labels:
            lengths = np.array([len(c) for c in chains])
            flat = self.word_ids([w for c in chains for w in c])
            table = self.scores
            first = np.concatenate([[0], np.cumsum(lengths)])
            order = np.argsort(-lengths, kind="stable")
            start = np.full(len(self.labels), 1 / len(self.labels))
            move = np.exp(self.move)
            own = np.array(owner)
            for lo, hi in _batches(lengths[order]):
                part = order[lo:hi]
                most = lengths[part[0]]
                places = np.minimum(first[part][:, None] + np.arange(most), len(flat) - 1)
                post, _ = forward_backward(table[flat[places]], lengths[part], move, start)
                post[np.arange(most)[None, :] >= lengths[part][:, None]] = 0
                np.add.at(total, own[part], post.sum(1))
        out = []
        for row in total:
            s = row.sum()
            k = int(row.argmax()) if s > 0 else -1
            out.append((self.labels[k], float(min(1.0, row[k] / s))) if s > 0 else (UNDETERMINED, 0.0))
        return out


def _batches(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of chains of like length, from long to short."""
    lo = 0
    while lo < len(lengths):
        hi = int(np.searchsorted(-lengths, -(lengths[lo] * 3 // 4), "right"))
        hi = max(lo + 1, min(hi, lo + 8192))
        yield lo, hi
        lo = hi


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Chain:
    """Maximise the conditional likelihood by adaptive gradient steps; ``samples`` are text and language."""
    labels = sorted({lang for _, lang in samples})
    model = Chain(labels)
    rng = np.random.default_rng(seed)
    pool = [(w, labels.index(lang)) for text, lang in samples for w in windows_of(text)]
    if not pool:
        return Chain([])
    pool = [pool[i] for i in rng.permutation(len(pool))[:MAX_WINDOWS]]
    chains = []
    for words, y in pool:
        if rng.random() < SWITCHED:
            other, z = pool[rng.integers(len(pool))]
            words, tags = words[: WINDOW // 2] + other[: WINDOW // 2], [y] * len(words[: WINDOW // 2]) + [z] * len(other[: WINDOW // 2])
        else:
            tags = [y] * len(words)
        chains.append((words, tags))
    vocabulary: dict[str, int] = {}
    for words, _ in chains:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    parts, rows = [], model.rows
    for w in vocabulary:
        parts.append([rows.setdefault(f, len(rows)) for f in word_features(w)])
    feature = np.array([f for p in parts for f in p])
    word = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(word, kind="stable")
    feature, word = feature[order], word[order]
    begin = np.searchsorted(word, np.arange(len(parts) + 1))
    size = len(labels)
    weights, seen_w = np.zeros((len(rows), size)), np.full((len(rows), size), 1e-2)
    move, seen_m = np.full((size, size), -1.0) + 2 * np.eye(size), np.full((size, size), 1.0)
    start = np.full(size, 1 / size)
    ids = [np.array([vocabulary[w] for w in words]) for words, _ in chains]
    for _ in range(EPOCHS):
        turn = rng.permutation(len(chains))
        for lo in range(0, len(turn), BATCH):
            part = sorted(turn[lo : lo + BATCH], key=lambda i: -len(ids[i]))
            lengths = np.array([len(ids[i]) for i in part])
            types, where = np.unique(np.concatenate([ids[i] for i in part]), return_inverse=True)
            spread = np.concatenate([np.arange(begin[t], begin[t + 1]) for t in types])
            of_type = np.repeat(np.arange(len(types)), begin[types + 1] - begin[types])
            score = np.zeros((len(types), size))
            np.add.at(score, of_type, weights[feature[spread]])
            first = np.concatenate([[0], np.cumsum(lengths)])
            most = lengths[0]
            places = np.minimum(first[:-1, None] + np.arange(most), len(where) - 1)
            post, moves = forward_backward(score[where[places]], lengths, np.exp(move), start)
            ok = np.arange(most)[None, :] < lengths[:, None]
            truth = np.concatenate([np.array(chains[i][1]) for i in part])
            error = post[ok] - np.eye(size)[truth]
            grad = np.zeros((len(types), size))
            np.add.at(grad, where, error)
            used, at = np.unique(feature[spread], return_inverse=True)
            g = np.zeros((len(used), size))
            np.add.at(g, at, grad[of_type])
            g += DECAY * BATCH * weights[used]
            seen_w[used] += g * g
            weights[used] -= STEP * g / np.sqrt(seen_w[used])
            same = truth[:-1], truth[1:]
            inner = np.ones(len(truth) - 1, bool)
            inner[first[1:-1] - 1] = False
            actual = np.zeros((size, size))
            np.add.at(actual, (same[0][inner], same[1][inner]), 1)
            g = moves - actual
            seen_m += g * g
            move -= STEP * g / np.sqrt(seen_m)
    model.weights, model.move = weights, move - move.max()
    return model


def training_texts(docs: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """Texts and languages outside the held-out quarter; at most ``max_docs``, chosen by a hash of the id, reach the driver.

    Of a text of more than ``MAX_LEARNT`` characters, so many from a place that the hash tells.
    """
    usable = docs.where(~held_out(id_col, 4, 2) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    ids = usable.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(max_docs)
    at = F.pmod(F.xxhash64(id_col), F.greatest(F.length(text_col) - MAX_LEARNT + 1, F.lit(1))).cast("int") + 1
    learnt = F.substr(text_col, at, F.lit(MAX_LEARNT))
    rows = usable.join(F.broadcast(ids), id_col).where(F.col(text_col).rlike(r"\p{L}")).select(id_col, learnt.alias(text_col), lang_col)
    return [(r[1], r[2]) for r in rows.orderBy(F.xxhash64(id_col), text_col, lang_col).limit(max_docs).collect()]


_HERE: dict[str, Chain] = {}  # a worker's models, so that remembered words outlast a task


def identify(docs: DataFrame, model: Chain | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``und`` with score 0 for a null text, one without letters, or where nothing could be learnt.
    ``score`` is the mean posterior of the language over the text's words.  Only the text is an input
    of a prediction; repeated rows stay.
    """
    import uuid

    model = fit(training_texts(docs, MAX_DOCS, id_col, text_col, lang_col)) if model is None else model
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's features

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _HERE:
            _HERE.clear()
            _HERE[key] = sent.value
        own = _HERE[key]
        for batch in batches:
            texts, out, lo, held = batch.column(1).to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                held += len(t or "")
                if held >= SLICE or i == len(texts) - 1:
                    out += own.label(texts[lo : i + 1])
                    lo, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    labelled = docs.select(id_col, text_col).mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")
    return labelled.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
