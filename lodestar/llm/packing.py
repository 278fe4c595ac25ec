"""Best-fit packing of tokenised documents into sequences of a fixed capacity (operator 2).

Plan: tokens are cut into pieces on the executors; only the histogram of piece lengths (at most
``capacity`` numbers, whatever the input) goes to the driver, where whole runs of equal lengths are
placed at once; each piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .scratch import materialize

CAPACITY = 1024
END_OF_TEXT = 2
#: Pieces that one window partition of a length is meant to hold.
RANK_ROWS = 200_000


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, eos: int = END_OF_TEXT, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: every document's ids then ``eos``, cut where longer than ``capacity``.

    All pieces but a document's first are exactly ``capacity`` long.  A null text counts as empty
    and gives one piece with ``eos`` alone.  ``ids`` holds little-endian unsigned 32-bit numbers.
    """
    json_path, ranks_path = paths or bpe.default_paths()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(json_path, ranks_path)
        tail = np.array([eos], dtype="<u4")
        for batch in batches:
            who, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), tail])
                n = len(ids)
                first = (n - 1) % capacity + 1
                data = ids.tobytes()
                for k, (lo, hi) in enumerate([(0, first), *((s, s + capacity) for s in range(first, n, capacity))]):
                    who.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(data[4 * lo : 4 * hi]))
                    if with_ids:
                        raw.append(data[4 * lo : 4 * hi])
            columns = [batch.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def place_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first rank, how many, first sequence, offset)`` for a histogram of lengths.

    Items above a third of the capacity fit at most twice in a bin, so they are matched greedily:
    from the longest down, each takes the longest item still free that fits beside it.  The smaller
    ones then go, longest first, to the tightest gap, and open a bin only where none is left.
    The number of runs depends on the distinct lengths alone.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    assert all(0 < k <= capacity for k in left), "a length must be from 1 to the capacity"
    given = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    sizes: list[int] = []  # the keys of gaps, ascending
    bins = 0

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(sizes, gap)
            gaps.setdefault(gap, []).append((first, n))

    def put(length: int, first: int, n: int, offset: int) -> None:
        runs.append((length, given[length], n, first, offset))
        given[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        top = large[-1]
        n = left[top]
        fits = bisect.bisect_right(large, capacity - top)
        mate = large[fits - 1] if fits else None
        if mate == top:
            n //= 2
            put(top, bins, n, 0)
            put(top, bins, n, top)
            keep(capacity - 2 * top, bins, n)
            bins += n
            if left[top]:  # the odd one takes the next shorter, if any
                mate = large[fits - 2] if fits > 1 else None
                n = 1
        if left[top]:
            n = min(left[top], left[mate]) if mate else left[top]
            put(top, bins, n, 0)
            if mate:
                put(mate, bins, n, top)
            keep(capacity - top - (mate or 0), bins, n)
            bins += n
        large = [k for k in large if left[k]]
    for length in sorted((k for k in left if left[k]), reverse=True):
        while left[length]:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                n = -(-left[length] // (capacity // length))
                keep(capacity, bins, n)
                bins += n
                continue
            gap = sizes[at]
            first, n = gaps[gap].pop()
            used = min(n, left[length])
            put(length, first, used, capacity - gap)
            if used < n:
                gaps[gap].append((first + used, n - used))
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            keep(gap - length, first, used)
    return runs


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to a table of pieces with ``doc_id, piece, length`` and any other columns, which stay as they are.

    ``pieces`` is read several times, so give a table or a materialised frame.  Repeated rows are
    packed as often as they occur.  An empty table gives an empty result.  Columns called
    ``sequence_id`` or ``offset`` are replaced.
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(place_lengths(counts, capacity), "run_length long, run_rank long, run_n long, run_sequence long, run_offset long")
    salts = max(8, -(-sum(counts.values()) // RANK_ROWS))
    whole = pieces.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), "doc_id", "piece", "length")
    salted = whole.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("place", place).join(before, ["length", "salt"]).select("own", "length", (F.col("place") + F.col("before")).alias("rank"))
    here = (F.col("rank") >= F.col("run_rank")) & (F.col("rank") < F.col("run_rank") + F.col("run_n"))
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & here)
    sequence = (F.col("run_sequence") + F.col("rank") - F.col("run_rank")).alias("sequence_id")
    return placed.select(*[F.col(f"own.`{c}`").alias(c) for c in columns], sequence, F.col("run_offset").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, eos: int = END_OF_TEXT, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset`` for every piece of every document.

    Other columns of ``docs``, whatever their names, are not looked at.  Nothing is dropped: a null
    or empty text is one piece, a repeated row is packed each time.  Broadcast: the table of runs,
    bounded by the number of distinct lengths.
    """
    return pack_pieces(materialize(token_pieces(docs, capacity, eos, id_col, text_col, paths, with_ids), "pieces"), capacity)
