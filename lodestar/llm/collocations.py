"""Phrase collocation mining by PCY/DHP hashing (operator 11).

Pass k counts the phrases of k words that can be frequent, and hashes all that pass k + 1 may have to count
into one table of ``BUCKETS`` small counters (PCY, and DHP beyond pairs).  Which buckets reached the least
count is a bitmap of fixed size, and so is which phrases of k words did, by their hashes.  Both go to the
tasks of the next pass: a phrase is counted only if its own bucket is full and both phrases of one word less
in it are frequent (Apriori).  A false positive of a bitmap costs a count and no more, as counts are exact.
Park, Chen and Yu, "An Effective Hash-Based Algorithm for Mining Association Rules" (1995).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, discard_since, materialize, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: Counters of a pass; the bitmaps of them and of frequent phrases take an eighth of that in bytes.
BUCKETS = 1 << 23
#: Counters in one row of a table on its way to be added up, and words of a task that are counted at a time.
BLOCK, WORDS = 1 << 16, 1 << 20
#: Different words whose numbers a task keeps at most, but for those of its last words.
VOCABULARY = 1 << 20
#: What stands for the end of a piece, and for no word at all.
END, NOTHING = -1, -2
#: Lower-cases A-Z, makes all ends of pieces line feeds and tabs spaces.
_TIDY = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256))
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> list[bytes]:
    """The words of ``text`` and ``\\n`` wherever a piece ends, with an empty token for each further space."""
    return (text or "").encode().translate(_TIDY).replace(b"\n", b" \n ").split(b" ")


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang))


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases, each with one more word at its end."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _MIX + words * _STEP
    return mixed ^ (mixed >> np.uint64(32))


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    return ((hashes * _STEP) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def marked(bitmap: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the places of the hashes; all, where there is no bitmap."""
    if bitmap is None:
        return np.ones(len(hashes), bool)
    at = places(hashes, len(bitmap) * 8)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Counters:
    """Counters of one task, which it sends on up to the least count, in as few bytes as hold it."""

    def __init__(self, size: int, least: int):
        self.least, self.kind = least, np.uint8 if least < 1 << 7 else np.uint32
        self.table = np.zeros(size, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        np.add.at(self.table, places(hashes, len(self.table)), np.uint32(1))
        if self.table.max(initial=0) > 1 << 31:
            np.minimum(self.table, self.least, out=self.table)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        for b in range(0, len(self.table), BLOCK):
            part = np.minimum(self.table[b : b + BLOCK], self.least).astype(self.kind)
            if part.any():
                yield b // BLOCK, part.tobytes()


def full_buckets(blocks: DataFrame, size: int, least: int) -> np.ndarray | None:
    """The bitmap of counters that reach ``least`` when all tables of ``block, counts`` are added up: ``size`` / 8 bytes."""
    kind = Counters(1, least).kind

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # as many as the counters have blocks here, whatever comes in
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counts.as_buffer(), kind)
                sums[block] = np.minimum(sums[block] + own, least).astype(kind) if block in sums else own
        full = {b: np.packbits(t >= least, bitorder="little").tobytes() for b, t in sums.items() if (t >= least).any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(full), pa.int32()), pa.array(list(full.values()), pa.binary())], ["block", "bits"])

    bitmap = np.zeros(size // 8, np.uint8)
    for row in blocks.repartition(F.col("block")).mapInArrow(add_up, "block int, bits binary").collect():
        part = np.frombuffer(bytes(row.bits), np.uint8)
        bitmap[row.block * BLOCK // 8 :][: len(part)] = part
    return bitmap


class Numbers(dict):
    """Numbers of the words of one language, given as they come up."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({b"\n": END, b"": NOTHING})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = len(self.words) - 1
        return len(self.words) - 1


class Vocabulary:
    """Numbers and hashes of up to some ``VOCABULARY`` different words."""

    def __init__(self):
        self.words: list[tuple[str, bytes]] = []
        self._numbers: dict[str, Numbers] = {}
        self._hashes = np.zeros(0, np.uint64)

    def of(self, lang: str) -> Numbers:
        return self._numbers.get(lang) or self._numbers.setdefault(lang, Numbers(lang, self.words))

    def hashes(self) -> np.ndarray:
        """The hash of each word by its number, and one for what is no word."""
        fresh = [word_hash(*w) for w in self.words[len(self._hashes) :]]
        self._hashes = np.append(self._hashes, np.array(fresh, np.uint64))
        return np.append(self._hashes, np.uint64(0))


def phrases(line: np.ndarray, words: np.ndarray, longest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For 1 to ``longest`` words: where phrases begin, and hashes of what begins at each place.  ``line`` has the numbers of words."""
    hashed, whole = [words[line]], [line >= 0]
    for n in range(1, longest):
        hashed.append(longer(hashed[-1][:-1], hashed[0][n:]))
        whole.append(whole[-1][:-1] & whole[0][n:])
    return [np.flatnonzero(w) for w in whole], hashed


def different(line: np.ndarray, at: np.ndarray, k: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of the different phrases of ``k`` words at ``at``, told apart by their words and not by hashes."""
    rank = line[at]
    for n in range(1, k):
        rank = np.unique(rank * words + line[at + n], return_inverse=True)[1]
    _, first, count = np.unique(rank, return_index=True, return_counts=True)
    return at[first], count


def _rows(lang: list, phrase: list, n, block: list, counts: list) -> pa.RecordBatch:  # noqa: ANN001
    kinds = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "block": pa.int32(), "counts": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((lang, phrase, n, block, counts), kinds.values(), strict=True)], list(kinds))


def _pass(docs: DataFrame, k: int, least: int, buckets: int, full: np.ndarray | None, frequent: np.ndarray | None, more: bool) -> DataFrame:
    """Rows ``lang, phrase, n`` of phrases of ``k`` words to be added up and, if ``more``, rows ``block, counts`` for those of ``k + 1``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(buckets, least)
        vocabulary, line, seen = Vocabulary(), array("i"), np.zeros(0, np.int64)

        def told(first: np.ndarray, numbers: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            own = [[vocabulary.words[n] for n in numbers[i : i + k]] for i in first.tolist()]
            none = [None] * len(own)
            return _rows([w[0][0] for w in own], [b" ".join(x for _, x in w).decode() for w in own], count, none, none)

        def flush() -> Iterator[pa.RecordBatch]:
            """Count what is in ``line``."""
            nonlocal seen
            numbers = np.frombuffer(line, np.int32)
            numbers = numbers[numbers != NOTHING].astype(np.int64)
            begins, hashed = phrases(numbers, vocabulary.hashes(), k + 1 if more else k)
            at = begins[k - 1]
            at = at[marked(full, hashed[k - 1][at])]
            if k > 1:  # all but the last word, and all but the first
                at = at[marked(frequent, hashed[k - 2][at])]
                at = at[marked(frequent, hashed[k - 2][at + 1])]
            if more:
                counted = np.zeros(len(numbers) + 1, bool)
                counted[at] = True
                then = begins[k]
                counters.add(hashed[k][then[counted[then] & counted[then + 1]]])
            if k == 1:  # words are added up for as long as their numbers hold
                seen = np.append(seen, np.zeros(len(vocabulary.words) - len(seen), np.int64)) + np.bincount(numbers[at], minlength=len(vocabulary.words))
            else:
                first, count = different(numbers, at, k, len(vocabulary.words))
                yield told(first, numbers.tolist(), count)

        def ended() -> Iterator[pa.RecordBatch]:
            """Tell the words counted so far."""
            for lo in range(0, len(seen), BLOCK):
                at = np.arange(lo, min(lo + BLOCK, len(seen)))
                yield told(at, range(len(seen)), seen[at])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                line.extend(map(vocabulary.of(lang).__getitem__, tokens(text.as_py())))
                line.append(END)
                if len(line) >= WORDS:
                    yield from flush()
                    line = array("i")
                    if len(vocabulary.words) >= VOCABULARY:
                        yield from ended()
                        vocabulary, seen = Vocabulary(), np.zeros(0, np.int64)
        yield from flush()
        yield from ended()
        if more:
            for block, counts in counters.blocks():
                yield _rows([None], [None], [None], [block], [counts])

    return docs.mapInArrow(work, "lang string, phrase string, n long, block int, counts binary")


def _frequent(phrases: DataFrame, buckets: int) -> DataFrame:
    """``block, counts`` of the hashes of ``lang, phrase``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(buckets, 1)
        for batch in batches:
            words = [[word_hash(lang, w) for w in phrase.encode().split(b" ")] for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = np.array(words, np.uint64).reshape(len(words), -1).T if words else []
            if len(columns):
                hashed = columns[0]
                for column in columns[1:]:
                    hashed = longer(hashed, column)
                counters.add(hashed)
        for block, counts in counters.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts], pa.binary())], ["block", "counts"])

    return phrases.select("lang", "phrase").mapInArrow(work, "block int, counts binary")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f`` of all phrases of up to ``longest`` words that occur ``least`` times or more in ``lang, text``, and ``lang, n``: words of each language."""
    found, totals, full, frequent = [], None, None, None
    for k in range(1, longest + 1):
        rows = materialize(_pass(docs, k, least, buckets, full, frequent, k < longest), f"phrases-{k}")
        exact = rows.where("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            words = materialize(exact, "words")
            totals = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
            exact = words
        own = materialize(exact.where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("k"), "f"), f"frequent-{k}")
        found.append(own)
        if k < longest:
            full = full_buckets(rows.where("block is not null").select("block", "counts"), buckets, least)
            frequent = full_buckets(_frequent(own, buckets), buckets, 1)
        discard(*([rows, words] if k == 1 else [rows]))
    table = found[0]
    for own in found[1:]:
        table = table.union(own)
    return table, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by score, count and bytes; all, if ``top`` is None.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends; phrases lie within pieces,
    overlaps count.  A phrase of ``a`` occurrences, cut in two parts of ``l`` and ``r``, scores
    ``floor(1000 * a * n / (l * r))`` of ``n`` words; the lowest-scoring cut counts, of equal ones the first.  A phrase
    within a longer one that is as frequent is left out.  A null language is ``und``, an empty one stays; null
    and empty texts have no words; repeated rows count as often as they occur; other columns are not looked at;
    an empty table, or one without frequent phrases, gives an empty result.
    """
    mark = written()
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    phrases, totals = frequent_phrases(rows, least, longest, buckets)
    long = phrases.where("k > 1").withColumn("words", F.split("phrase", " "))

    cut = long.select("lang", "phrase", "k", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("after"))
    cut = cut.select("lang", "phrase", "a", "after", F.array_join(F.slice("words", 1, F.col("after")), " ").alias("first"), F.array_join(F.slice("words", F.col("after") + 1, F.col("k")), " ").alias("rest"))
    parts = phrases.select("lang", "phrase", "f")  # what a frequent phrase consists of is frequent
    cut = cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    exact = "(1000 * cast(a AS decimal(15, 0)) * cast(n AS decimal(18, 0))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))"  # at most 10 * n
    cut = cut.withColumn("score", F.expr(exact))
    scored = cut.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min("n").alias("n"), F.min(F.struct("score", "after", "l", "r")).alias("lowest"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    within = long.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where("longer is null or longer < a")
    kept = kept.select("lang", "phrase", "a", F.col("lowest.l").alias("l"), F.col("lowest.r").alias("r"), "n", F.col("lowest.score").alias("score"))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    out = materialize((ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard_since(mark, docs.sparkSession, out)
    return out
