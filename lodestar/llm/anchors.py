"""SimHash near-dedup by anchor-point covering (operator 13).

Anchors are the words of a covering code of the 64-bit space: two perfect Golay codes of 23 bits (covering
radius 3) and, on the last 18, a perfect Hamming code of 15 bits (radius 1) beside 3 bits as they are.  A
fingerprint goes to every anchor within the covering radius and half the threshold.  Of two fingerprints
within the threshold, a point half way between them lies within half the threshold of both; an anchor is
within the covering radius of that point, so both go to it and none is missed.  From one side alone it
would take the covering radius and the whole threshold, and twenty times the copies.

Most thresholds need not all 64 bits: fingerprints within 4 bits are within 2 in two of the three parts.
So anchors of two parts serve up to ``WHOLE`` fingerprints, and those of all three beyond; pairs are the same.
Afrati et al., "Anchor-Points Algorithms for Hamming and Edit Distances Using MapReduce" (2014).

Per anchor, fingerprints are compared in chunks of bounded size.  Where an anchor holds several chunks,
what is not in its largest component so far is compared with all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import discard_since, materialize, written

SHINGLE, DISTANCE = 4, 4
#: Fingerprints up to which anchors of two of the three parts keep buckets small.
WHOLE = 100_000_000
#: Fingerprints in one chunk of an anchor, on average.
CHUNK = 1024
#: Rows up to which a table is broadcast; more are joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Shingle hashes whose bits are counted at a time.
STEP = 255 * 256
#: Generator of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
_BYTES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; eight counts to a word, in bytes, of 255 hashes at a time."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), STEP):
        part = hashes[lo : lo + STEP]
        part = np.append(part, np.zeros(-len(part) % 255, np.uint64)).reshape(-1, 255)
        for bit in range(8):
            lanes = ((part >> np.uint64(bit)) & _BYTES).sum(1, dtype=np.uint64)
            counts[bit::8] += lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes))))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of ``text``, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
    joined = b" ".join(words)
    starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
    ends = [e - 1 for e in starts[shingle:]]
    hashed = xxhash.xxh64_intdigest
    return majority(np.array([hashed(joined[s:e], 42) for s, e in zip(starts, ends, strict=False)], np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` is the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(work, f"doc_id {kind}, fp long")


def _golay_checks() -> list[int]:
    """What each of 23 bits adds to a syndrome: x^i modulo the generator."""
    checks, power = [], 1
    for _ in range(23):
        checks.append(power)
        power <<= 1
        power ^= GOLAY if power >> 11 else 0
    return checks


#: Each part of a fingerprint: its first bit, its width, how many of its bits a perfect code covers, that code's radius, and what bits add to a syndrome.
PARTS = [(0, 23, 23, 3, _golay_checks()), (23, 23, 23, 3, _golay_checks()), (46, 18, 15, 1, list(range(1, 16)))]


class Cosets:
    """For each syndrome of a part, the differences to its anchors by level: how far beyond the covering radius they are."""

    def __init__(self, part: int, most: int):
        self.first, self.width, self.coded, radius, self.checks = PARTS[part]
        found: list[list[tuple[int, int]]] = [[] for _ in range(1 << max(self.checks).bit_length())]
        for weight in range(radius + most + 1):
            for bits in combinations(range(self.coded), weight):
                syndrome, mask = 0, 0
                for b in bits:
                    syndrome ^= self.checks[b]
                    mask |= 1 << b
                found[syndrome].append((max(0, weight - radius), mask))
        plain = [(w, sum(1 << (self.coded + b) for b in bits)) for w in range(most + 1) for bits in combinations(range(self.width - self.coded), w)]
        rows = [sorted((i + j, x | y) for (i, x), (j, y) in product(own, plain) if i + j <= most) for own in found]
        #: Differences of all syndromes in a row, where each begins, and how many have up to each level.
        self.masks = np.array([m for row in rows for _, m in row], np.int64)
        self.levels = np.array([lv for row in rows for lv, _ in row], np.int64)
        self.starts = np.cumsum([0] + [len(row) for row in rows])[:-1]
        self.counts = np.array([[sum(lv <= b for lv, _ in row) for b in range(most + 1)] for row in rows], np.int64)

    def expand(self, fp: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each fingerprint and the levels that are left to it: its place, this part of an anchor, and what is then left."""
        bits = (fp >> np.uint64(self.first)).astype(np.int64) & ((1 << self.width) - 1)
        syndrome = np.zeros(len(fp), np.int64)
        for i, check in enumerate(self.checks):
            syndrome ^= (bits >> i & 1) * check
        n = self.counts[syndrome, left]
        place = np.repeat(np.arange(len(fp)), n)
        at = np.repeat(self.starts[syndrome] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return place, bits[place] ^ self.masks[at], left[place] - self.levels[at]


@cache
def cosets(part: int, most: int) -> Cosets:
    return Cosets(part, most)


def anchors(fp: np.ndarray, parts: int, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """``place, anchor``: every anchor of the fingerprints (unsigned) in each choice of so many parts."""
    most = distance * parts // len(PARTS) - distance * parts // len(PARTS) // 2  # the longer half of what they may differ by there
    places, keys = [], []
    for n, chosen in enumerate(combinations(range(len(PARTS)), parts)):
        place, key, left = np.arange(len(fp)), np.full(len(fp), n, np.int64), np.full(len(fp), most, np.int64)
        for part in chosen:
            then, word, left = cosets(part, most).expand(fp[place], left)
            place, key = place[then], key[then] << PARTS[part][1] | word
        places.append(place)
        keys.append(key)
    return np.concatenate(places), np.concatenate(keys)


def anchored(distinct: DataFrame, parts: int, distance: int) -> DataFrame:
    """``anchor, fp``: each fingerprint of ``fp`` beside every anchor that it goes to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            place, anchor = anchors(fp.view(np.uint64), parts, distance)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[place])], ["anchor", "fp"])

    return distinct.select("fp").mapInArrow(work, "anchor long, fp long")


def local_components(fp: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint (unsigned) of a chunk, the place of the first one that it is linked with, directly or not."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
    label = np.arange(len(fp))
    while True:
        least = np.where(near, label[None, :], len(fp)).min(1)
        least = np.minimum(least, least[least])
        if np.array_equal(least, label):
            return label
        label = least


def _chunk_links(packed: DataFrame, distance: int) -> DataFrame:
    """``a, b``: each fingerprint of a chunk with the first one of its component there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for chunk in batch.column(0):
                fp = chunk.values.to_numpy()
                label = local_components(fp.view(np.uint64), distance)
                moved = label != np.arange(len(fp))
                a.append(fp[moved])
                b.append(fp[label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return packed.select("fps").mapInArrow(work, "a long, b long")


def _cross_links(met: DataFrame, distance: int) -> DataFrame:
    """``a, b``: of each two components of which two chunks hold linked fingerprints, one such pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in zip(*batch.columns, strict=True):
                x, cx, y, cy = (v.values.to_numpy() for v in row)
                i, j = np.nonzero((np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]) <= distance) & (cx[:, None] != cy[None, :]))
                _, first = np.unique(np.stack([cx[i], cy[j]]), axis=1, return_index=True)
                a.append(x[i[first]])
                b.append(y[j[first]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return met.select("rest", "rest_of", "fps", "fps_of").mapInArrow(work, "a long, b long")


def _chunked(members: DataFrame, size: int) -> DataFrame:
    """``anchor, fp, n`` dealt to chunks of about ``size`` by a hash, another one at each anchor."""
    return members.withColumn("chunk", F.pmod(F.xxhash64("anchor", "fp"), F.ceil(F.col("n") / size)))


def fingerprint_classes(distinct: DataFrame, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """``node, component`` of the different fingerprints ``fp`` that are linked with another, by links of ``distance`` or fewer bits."""
    parts = parts or (2 if distinct.count() <= WHOLE else len(PARTS))
    found = anchored(distinct, parts, distance)
    ends = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    # most anchors that are shared at all are shared by two: their only pair is the least and the largest, told apart here
    shared = materialize(ends.where((F.col("n") > 2) | (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)), "anchors")
    more = shared.where("n > 2").select("anchor", "n")
    members = found.join(F.broadcast(more) if more.count() <= BROADCAST_ROWS else more, "anchor")
    members = materialize(members, "anchored")
    packed = _chunked(members, CHUNK).groupBy("anchor", "chunk").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # CHUNK or so
    links = materialize(shared.where("n = 2").select("a", "b").union(_chunk_links(packed, distance)).distinct(), "near")
    components = materialize(connected_components(links), "components")

    wide = members.where(F.col("n") > CHUNK)
    if wide.isEmpty():
        return components
    known = wide.join(components, wide.fp == components.node, "left").select("anchor", "fp", "n", F.coalesce("component", "fp").alias("of"))
    known = materialize(known, "wide-anchors")
    sizes = known.groupBy("anchor", "of").agg(F.count(F.lit(1)).alias("k"))
    top = sizes.groupBy("anchor").agg(F.max_by("of", F.struct("k", "of")).alias("top"), F.count(F.lit(1)).alias("components")).where("components > 1")
    split = known.join(top, "anchor")
    every = _chunked(split, CHUNK).groupBy("anchor", "chunk").agg(F.collect_list(F.struct("fp", "of")).alias("own"))
    every = materialize(every.select("anchor", F.col("own.fp").alias("fps"), F.col("own.of").alias("fps_of")), "whole-anchors")
    rest = _chunked(split.where("of <> top"), CHUNK).groupBy("anchor", "chunk").agg(F.collect_list(F.struct("fp", "of")).alias("own"))
    met = rest.select("anchor", F.col("own.fp").alias("rest"), F.col("own.of").alias("rest_of")).join(every, "anchor")
    late = materialize(_cross_links(met, distance).distinct(), "near-2")
    return components if late.isEmpty() else materialize(connected_components(links.union(late)), "components-2")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: fingerprints that differ in ``distance`` bits or fewer are linked.

    A fingerprint has the bits that over half the XXH64 (seed 42) hashes of a text's word shingles have; a
    shorter text is one shingle, a null or wordless one has fingerprint zero and is linked like any other.
    ``component_id`` is the smallest id in the component; a null id never names one, unless all its ids are
    null, but links like any other.  Repeated rows stay, in one component; other columns are not looked at;
    an empty table gives an empty result.  ``parts`` forces the choice of anchors.
    """
    spark, mark = docs.sparkSession, written()
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    classes = fingerprint_classes(distinct, distance, parts)
    placed = distinct.join(classes, distinct.fp == classes.node, "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("k"))
    # alone: the row is its own class, known without a join
    named = placed.join(least, "component").where("n > 1 or k > 1").select("fp", "first")
    named = materialize(named, "classes")
    discard_since(mark, spark, rows, named)
    small = named.count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(named) if small else named, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("first", "doc_id").alias("component_id"))
