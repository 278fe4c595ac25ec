"""N-gram Jaccard join by token groups (operator 3).

Sets of shingles are held as 64-bit fingerprints.  Two sets whose similarity reaches p/q differ in at
most k = (q - p)(|A| + |B|) / (p + q) shingles; cut into more than k parts by fingerprint, they agree
in at least one part.  Agreement in a part routes similar sets to one bucket; no part follows from a
shared passage or a frequent shingle alone, so such text makes no bucket.  In a bucket, sets are
gathered into groups; a query set is held against a group's union of shingles first, and only groups
whose union can reach the needed overlap are opened and compared set by set.

Before that, each set is held against all others that share a bucket as if they were one group: its
tokens that none of them has count against the overlap it needs, and most sets go here.  What stays is
dealt into groups by a bucket of theirs, each group written once with its union of tokens.  Groups that
share a bucket meet: first each with the most widely shared group of the bucket, then, where a bucket
still spans several components, with the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .linking import shared_buckets
from .scratch import discard, discard_since, materialize, written

SHINGLE = 5
SIMILARITY = (4, 5)
#: Growth of the size classes; spare parts per needed part; other cuts tried for sets with many empty parts.
GROWTH, SPARE, CUTS = 1.25, 0.08, 6
#: Characters handled at once, routing entries held before they are written, and entries of one
#: bucket in them beyond which they are written as rows.
SLICE, FLUSH, HEAVY = 1 << 21, 1 << 20, 64
#: Sets and tokens in a group; tokens of the groups that one group meets at once; tokens in a shard.
GROUP, GROUP_TOKENS, BLOCK_TOKENS, SHARD_TOKENS = 128, 1 << 18, 1 << 21, 1 << 22
#: Ids up to this many are broadcast to pick texts; more are joined by shuffling.
BROADCAST_IDS = 1_000_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: A routing entry: the low five bytes of the bucket, whose shard is known, and the set.
ENTRY, LOW = np.dtype([("b", "u1", 5), ("s", "<u8")]), np.uint64((1 << 40) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's ``width``-word shingles.

    A-Z are lower-cased, words end at ASCII white space.  A text with fewer words gives one shingle,
    its whole sequence; a text without words, or null, the empty set.
    """
    import xxhash

    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    total = sum(map(len, words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, total)
    rolled = np.zeros(total, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    span = max(0, total - width + 1)
    for j in range(width):
        rolled[:span] = rolled[:span] * base + h[j : j + span]
    rolled[:span] = mix(rolled[:span])
    sets, at = [], 0
    for w in words:
        n = len(w)
        if n >= width:
            sets.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            one = np.uint64(n)
            for x in h[at : at + n]:
                one = np.uint64((int(one) * int(base) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            sets.append(mix(np.array([one], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


class Router:
    """The parts in which two sets of similarity p/q must agree at least once."""

    def __init__(self, similarity: tuple[int, int]):
        self.p, self.q = similarity
        low = 1
        while (self.q - self.p) * (2 * low + 1) // (self.p + self.q) < 1:
            low += 1
        self.lows = [low]  # smaller sets link to equal ones only

    def class_of(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * GROWTH)))
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def entries(self, s: np.ndarray) -> np.ndarray:
        """The buckets of one set: one for each part without the empty ones, in each class that a partner can have."""
        n = len(s)
        first, last = self.class_of(n), self.class_of(n * self.q // self.p)
        out = []
        for c in range(max(first, 0), last + 1):
            most = self.lows[c + 1] - 1
            k = (self.q - self.p) * 2 * most // (self.p + self.q)
            spare = 1 + int(k * SPARE)
            parts = k + 1 + spare
            for cut in range(CUTS):
                x = s if not cut else np.sort(mix(s + np.uint64(cut * 7919)))
                part = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                own = np.add.reduceat(mix(x + np.uint64(0x632BE59BD9B4E019)), starts)
                tag = mix(np.array([c * CUTS + cut + 1], np.uint64))
                out.append(mix(own + part[starts] * np.uint64(0xA0761D6478BD642F) + tag))
                empty = parts - len(starts)
                if empty <= spare:
                    break
                if cut == CUTS - 1:  # so sparse in every cut that agreeing in emptiness must count
                    gone = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[starts])
                    out.append(mix(gone * np.uint64(0xA0761D6478BD642F) + tag))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_ids(s: np.ndarray) -> int:
    """One number for a set: equal sets have equal ones."""
    return int(mix(np.array([mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str | None]]]:
    """Places and texts of a batch, some ``SLICE`` characters at a time; the text is the last column."""
    texts, lo, held = batch.column(batch.num_columns - 1).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE or i == len(texts) - 1:
            yield lo, i + 1 - lo, texts[lo : i + 1]
            lo, held = i + 1, 0


def _records(columns: dict[str, tuple[pa.DataType, pa.Array | None]], size: int) -> pa.RecordBatch:
    """A batch of ``size`` rows; columns without values are null."""
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else c for t, c in columns.values()], list(columns))


def _shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each fingerprint; ascends with it."""
    return ((x >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def route(docs: DataFrame, width: int, similarity: tuple[int, int], shards: int, kind: str) -> DataFrame:
    """One pass over the texts: ``doc_id, digest, n, set_id`` of each row, and ``bucket, item`` of what shares a bucket.

    ``docs`` has ``doc_id, digest, text``.  Routing entries cross the network once, packed by shard
    (five bytes of the bucket, as its shard tells the rest, and the set), and are never written as rows:
    a shard gives back only its buckets of two different sets or more.
    """
    names = {"shard": pa.int32(), "doc_id": None, "digest": pa.int64(), "n": pa.int64(), "set_id": pa.int64(), "bucket": pa.int64(), "entries": pa.binary()}

    def emit(size: int, shard: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
        columns["shard"] = pa.array(shard, pa.int32())
        return _records({c: (t, columns.get(c)) for c, t in names.items()}, size)

    def flush(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.concatenate(pairs, axis=1).T.copy().view([("b", "<u8"), ("s", "<u8")]).ravel())
        starts = np.flatnonzero(np.concatenate([[True], pairs["b"][1:] != pairs["b"][:-1]]))
        own = np.diff([*starts, len(pairs)])
        place, size = np.arange(len(pairs)) - np.repeat(starts, own), np.repeat(own, own)
        heavy = (size > HEAVY) & (place > 1)  # two stay, so that the shard knows the bucket
        if heavy.any():
            rows = pairs[heavy]
            shard, low = _shard_of(rows["b"], shards), rows["b"] & LOW
            bucket = ((shard.astype(np.uint64) << np.uint64(40)) | low).view(np.int64)
            yield emit(len(rows), _shard_of(mix(rows["s"]), shards), bucket=pa.array(bucket), set_id=pa.array(np.ascontiguousarray(rows["s"]).view(np.int64)))
        pairs = pairs[~heavy]
        ends = np.searchsorted(_shard_of(pairs["b"], shards), np.arange(shards + 1))
        full = np.flatnonzero(np.diff(ends))
        packed = np.empty(len(pairs), ENTRY)
        packed["b"] = pairs["b"].copy().view(np.uint8).reshape(-1, 8)[:, :5]
        packed["s"] = pairs["s"]
        yield emit(len(full), full, entries=pa.array([packed[ends[i] : ends[i + 1]].tobytes() for i in full], pa.binary()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, held, count, seen = Router(similarity), [], 0, 0
        for batch in batches:
            names["doc_id"] = batch.schema.field(0).type
            for lo, size, texts in slices(batch):
                sets = shingle_sets(texts, width)
                own = np.array([set_ids(s) for s in sets], np.int64)
                rows = {"doc_id": batch.column(0).slice(lo, size), "digest": batch.column(1).slice(lo, size), "n": pa.array([len(s) for s in sets], pa.int64()), "set_id": pa.array(own)}
                yield emit(size, (np.arange(seen, seen + size) * 7919) % shards, **rows)  # any shard: equal sets must not meet
                seen += size
                for s, i in zip(sets, own.view(np.uint64), strict=True):
                    if len(s) and len(e := router.entries(s)):
                        held.append(np.stack([e, np.full(len(e), i, np.uint64)]))
                        count += len(e)
                if count >= FLUSH:
                    yield from flush(held)
                    held, count = [], 0
        if count:
            yield from flush(held)

    def shared(table: pa.Table) -> pa.Table:
        entries = table.column("entries").drop_null().to_pylist()
        rows = table.filter(pc.is_null(table.column("entries"))).select(["doc_id", "digest", "n", "set_id", "bucket"])
        if not entries:
            return rows
        packed = np.frombuffer(b"".join(entries), ENTRY)
        pairs = np.zeros(len(packed), [("b", "<u8"), ("s", "<u8")])
        low = np.zeros((len(packed), 8), np.uint8)
        low[:, :5] = packed["b"]
        pairs["b"], pairs["s"] = low.view("<u8").ravel(), packed["s"]
        pairs = np.unique(pairs)
        same = pairs["b"][1:] == pairs["b"][:-1]
        own = pairs[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        shard = np.uint64(table.column("shard")[0].as_py())
        found = {"bucket": pa.array(((shard << np.uint64(40)) | own["b"]).view(np.int64)), "set_id": pa.array(np.ascontiguousarray(own["s"]).view(np.int64))}
        return pa.concat_tables([rows, pa.Table.from_batches([_records({c: (rows.schema.field(c).type, found.get(c)) for c in rows.column_names}, len(own))])])

    packed = docs.mapInArrow(work, f"shard int, doc_id {kind}, digest long, n long, set_id long, bucket long, entries binary")
    return packed.groupBy("shard").applyInArrow(shared, f"doc_id {kind}, digest long, n long, set_id long, bucket long")


def lonely_tokens(texts: DataFrame, width: int, shards: int) -> DataFrame:
    """``item, lonely``: how many tokens of a set no other set of ``texts`` (one row for each set) has; sets without such tokens have no row.

    Tokens cross the network in four bytes each, packed by shard.  Two tokens that agree in their shard
    and those bytes count as one: what a set shares is never understated.
    """

    def flush(sets: list[np.ndarray], own: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(sets)
        shard, of = _shard_of(flat, shards), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(shard, kind="stable")
        shard, of, low = shard[order], of[order], (flat[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
        ends, ids = np.searchsorted(shard, np.arange(shards + 1)), np.array(own, "<i8")
        full, items, sizes, tokens = np.flatnonzero(np.diff(ends)), [], [], []
        for i in full:
            part = of[ends[i] : ends[i + 1]]
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            items.append(ids[part[starts]].tobytes())
            sizes.append(np.diff([*starts, len(part)]).astype("<u4").tobytes())
            tokens.append(low[ends[i] : ends[i + 1]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in (items, sizes, tokens))], ["shard", "items", "sizes", "tokens"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, count = [], [], 0
        for batch in batches:
            for _, _, some in slices(batch):
                for s in shingle_sets(some, width):
                    if len(s):
                        held.append(s)
                        own.append(set_ids(s))
                        count += len(s)
                if count >= FLUSH:
                    yield flush(held, own)
                    held, own, count = [], [], 0
        if count:
            yield flush(held, own)

    def single(table: pa.Table) -> pa.Table:
        joined = {c: b"".join(table.column(c).to_pylist()) for c in ("items", "sizes", "tokens")}
        of = np.repeat(np.frombuffer(joined["items"], "<i8"), np.frombuffer(joined["sizes"], "<u4"))
        _, first, n = np.unique(np.frombuffer(joined["tokens"], "<u4"), return_index=True, return_counts=True)
        items, lonely = np.unique(of[first[n == 1]], return_counts=True)
        return pa.table({"item": pa.array(items, pa.int64()), "lonely": pa.array(lonely, pa.int64())})

    packed = texts.mapInArrow(spread, "shard int, items binary, sizes binary, tokens binary")
    counts = packed.groupBy("shard").applyInArrow(single, "item long, lonely long")
    return counts.groupBy("item").agg(F.sum("lonely").alias("lonely"))


def token_groups(texts: DataFrame, width: int, placed: DataFrame) -> DataFrame:
    """One row for each group of ``placed`` (``item, group``): its sets, smallest first, and the union of their tokens."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, some in slices(batch):
                sets = shingle_sets(some, width)
                yield pa.RecordBatch.from_arrays([pa.array([set_ids(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["item", "own"])

    def gather(table: pa.Table) -> pa.Table:
        sets = dict(zip(table.column("item").to_pylist(), table.column("own").to_pylist(), strict=True))
        items = sorted(sets, key=lambda i: (len(sets[i]), i))
        flat = b"".join(sets[i] for i in items)
        union = np.unique(np.frombuffer(flat, np.uint64))
        one = {"group": table.column("group")[0].as_py(), "items": items, "ends": np.cumsum([len(sets[i]) // 8 for i in items]).tolist(), "tokens": flat, "union_tokens": union.tobytes()}
        return pa.Table.from_pylist([one], pa.schema([("group", pa.int64()), ("items", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("tokens", pa.binary()), ("union_tokens", pa.binary())]))

    made = texts.mapInArrow(tokens, "item long, own binary").join(placed, "item")
    return made.groupBy("group").applyInArrow(gather, "group long, items array<long>, ends array<long>, tokens binary, union_tokens binary")


class Group:
    """A group of sets with its union of tokens and the least set in it."""

    def __init__(self, items: list[int], ends: list[int], tokens: bytes, union: bytes, components: list[int] | None = None):
        self.items, self.flat, self.union = np.array(items, np.int64), np.frombuffer(tokens, np.uint64), np.frombuffer(union, np.uint64)
        self.starts = np.array([0, *ends[:-1]], np.int64)
        self.sizes = np.diff([*self.starts, ends[-1]])
        self.components = self.items if components is None else np.array(components, np.int64)

    def sets(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """``item, component, set`` of each member."""
        for item, component, lo, n in zip(self.items.tolist(), self.components.tolist(), self.starts.tolist(), self.sizes.tolist(), strict=True):
            yield item, component, self.flat[lo : lo + n]

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        """Tokens that each member has in common with ``s``."""
        at = np.searchsorted(s, self.flat)
        at[at == len(s)] = 0
        return np.add.reduceat((s[at] == self.flat).astype(np.int64), self.starts)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked_members(item: int, s: np.ndarray, group: Group, similarity: tuple[int, int]) -> list[int]:
    """Members of a group whose similarity to the set ``s`` is p/q or more.

    The overlap with any member is at most that with the union of the group's tokens; where that is too
    little for the least member that could do, the group stays closed.
    """
    p, q = similarity
    a = len(s)
    fits = (q * group.sizes >= p * a) & (q * a >= p * group.sizes)
    if not a or not fits.any():
        return []
    if (p + q) * overlap(s, group.union) < p * (a + int(group.sizes[fits].min())):
        return []
    found = fits & ((p + q) * group.overlaps(s) >= p * (a + group.sizes))
    return [i for i in group.items[found].tolist() if i != item]


def open_groups(units: dict, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Links of a spanning forest between query sets and group members, unit by unit.

    ``units`` maps a key to ``(group, queries)``: a ``Group``, and those whose sets are held against it.
    """
    links = []
    for group, queries in units.values():
        root: dict = {}

        def find(x: int, root: dict = root) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root.setdefault(root[x], root[x])
                x = root[x]
            return x

        known = dict(zip(group.items.tolist(), group.components.tolist(), strict=True))
        there = set(known.values())
        for query in queries:
            for item, component, s in query.sets():
                if all(find(c) == find(component) for c in there):
                    continue
                for other in linked_members(item, s, group, similarity):
                    if find(known[other]) != find(component):
                        links.append((item, other))
                        root[find(known[other])] = find(component)
                there = {find(c) for c in there}
    return links


def compare(meets: DataFrame, groups: DataFrame, similarity: tuple[int, int], least_blocks: int) -> DataFrame:
    """Links ``a, b`` found where the groups of ``meets`` (``group, other``; both may be one) meet.

    The sets of ``other`` are the queries.  Every group of ``groups`` also has ``components``, null where each set is its own.  A group is sent once for each ``BLOCK_TOKENS`` tokens of the
    groups that it meets, which bounds a task's portion.
    """

    def task(table: pa.Table) -> pa.Table:
        units: dict = {}
        for row in sorted(table.to_pylist(), key=lambda r: r["role"]):
            one = Group(row["items"], row["ends"], row["tokens"], row["union_tokens"] or b"", row["components"])
            if row["role"] == 0:
                units[row["unit"]] = (one, [])
            else:
                units[row["unit"]][1].append(one)
        links = open_groups(units, similarity)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    size = groups.select(F.col("group").alias("other"), F.element_at("ends", -1).alias("size"))
    chunks = meets.join(size, "other").groupBy("group").agg(F.sum("size").alias("size"))
    chunks = chunks.select("group", "size", F.ceil(F.col("size") / BLOCK_TOKENS).cast("int").alias("chunks"))
    blocks = max(least_blocks, (chunks.agg(F.sum("size")).first()[0] or 0) // BLOCK_TOKENS)
    unit = F.xxhash64("group", F.col("chunk").cast("long"))
    queries = meets.join(chunks, "group").withColumn("chunk", F.pmod(F.xxhash64("other"), "chunks")).select(unit.alias("unit"), F.col("other").alias("group"), F.lit(1).alias("role"))
    owners = chunks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(unit.alias("unit"), "group", F.lit(0).alias("role"))
    work = queries.union(owners).join(groups, "group").withColumn("union_tokens", F.when(F.col("role") == 0, F.col("union_tokens")))
    return work.withColumn("block", F.pmod("unit", F.lit(blocks))).groupBy("block").applyInArrow(task, "a long, b long")


def jaccard_classes(docs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """``doc_id, digest, n, class`` of each row of ``doc_id, digest, text``: sets linked by similarity p/q share a class, which is null for the empty set."""
    spark = docs.sparkSession
    p, q = similarity
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = written()
    routed = materialize(route(docs, shingle, similarity, max(64, 4 * parts), kind), "routed")
    rows = routed.where("n is not null").select("doc_id", "digest", "n", "set_id")
    buckets = shared_buckets(routed.where("bucket is not null").select("bucket", F.col("set_id").alias("item")))
    items = buckets.select("item").distinct()
    # one row for each set that shares a bucket, if need be one without an id
    firsts = rows.join(items, rows.set_id == items.item, "left_semi").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("row"), F.first("n").alias("n"))
    firsts = materialize(firsts.select(F.col("set_id").alias("item"), "row.doc_id", "row.digest", "n"), "firsts")

    def picked(wanted: DataFrame) -> DataFrame:
        keys = wanted.select(F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest"))
        keys = F.broadcast(keys) if wanted.count() <= BROADCAST_IDS else keys
        return docs.join(keys, (F.col("digest") == F.col("own_digest")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi").select("text")

    tokens = firsts.agg(F.sum("n")).first()[0] or 0
    lonely = lonely_tokens(picked(firsts), shingle, max(16, tokens // SHARD_TOKENS))
    able = firsts.join(lonely, "item", "left").where(q * (F.col("n") - F.coalesce("lonely", F.lit(0))) >= p * F.col("n")).select("item")
    buckets = shared_buckets(buckets.join(materialize(able, "able"), "item", "left_semi"))

    near = buckets.groupBy("item").agg(F.min_by("bucket", F.xxhash64("bucket")).alias("near")).join(firsts, "item")
    chunks = near.groupBy("near").agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("n") / GROUP_TOKENS)).alias("chunks"))
    placed = near.join(chunks, "near").select("item", "doc_id", "digest", F.xxhash64("near", F.pmod(F.xxhash64("item"), "chunks")).alias("group"))
    placed = materialize(placed, "placed")
    groups = materialize(token_groups(picked(placed), shingle, placed.select("item", "group")), "groups")
    alone = groups.withColumn("components", F.lit(None).cast("array<long>"))

    seen = buckets.join(placed, "item").groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("members"))
    spread = seen.groupBy("group").agg(F.sum("members").alias("spread"))
    hubs = seen.join(spread, "group").groupBy("bucket").agg(F.max(F.struct("spread", "group")).alias("top")).select("bucket", F.col("top.group").alias("hub"))
    first = seen.join(hubs, "bucket").select(F.col("hub").alias("group"), F.col("group").alias("other")).where("group <> other").distinct()
    own = groups.where(F.size("items") > 1).select("group", F.col("group").alias("other"))
    first = materialize(first.union(own), "meets-1")
    links = materialize(compare(first, alone, similarity, parts), "links-1")
    found = materialize(connected_components(links), "components-1")

    within = buckets.join(placed, "item").join(found.withColumnRenamed("node", "item"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    spans = within.groupBy("bucket", "group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    split = spans.groupBy("bucket").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most and n > 1").select("bucket")
    spans = materialize(spans.join(split, "bucket"), "spans")
    if not spans.isEmpty():
        theirs = spans.select("bucket", F.col("group").alias("other"), F.col("lo").alias("their_lo"), F.col("hi").alias("their_hi"))
        meets = spans.join(theirs, "bucket").where("group < other and not (lo = hi and their_lo = their_hi and lo = their_lo)").select("group", "other").distinct()
        done = first.select(F.least("group", "other").alias("group"), F.greatest("group", "other").alias("other"))
        sets = groups.select("group", F.size("items").alias("sets"))
        meets = meets.join(done, ["group", "other"], "left_anti").join(sets, "group").join(sets.select(F.col("group").alias("other"), F.col("sets").alias("their_sets")), "other")
        smaller = F.col("sets") < F.col("their_sets")  # the larger group is sent once for many that it meets
        meets = materialize(meets.select(F.when(smaller, F.col("other")).otherwise(F.col("group")).alias("group"), F.when(smaller, F.col("group")).otherwise(F.col("other")).alias("other")), "meets-2")
        of = groups.select("group", F.posexplode("items").alias("place", "node")).join(found, "node", "left")
        of = of.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("component", "node").alias("component")))).alias("c"))  # GROUP sets or so
        linked = groups.join(of.select("group", F.col("c.component").alias("components")), "group")
        links = materialize(links.union(compare(meets, linked, similarity, parts)), "links-2")
        found = materialize(connected_components(links), "components-2")

    discard_since(mark, spark, routed, found)
    own = rows.join(found, rows.set_id == found.node, "left")
    return own.select("doc_id", "digest", "n", F.when(F.col("n") > 0, F.coalesce("component", "set_id")).alias("class"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: texts of similarity p/q or more share a component.

    ``component_id`` is the smallest id in the component.  A null or wordless text has the empty set
    and is its own component; repeated rows stay, in one component; a null id never names one, unless
    all ids of the component are null, but links like any other.  Other columns, whatever their names, are not looked at.
    """
    own = jaccard_classes(_keyed(docs, id_col, text_col), shingle, similarity)
    least = own.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    return own.join(least, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``: that of the smallest id, null ids last, ties by a hash of the text.

    Of repeated rows any one stays.  Rows without words are linked with nothing and all stay.
    """
    mark = written()
    classes = materialize(jaccard_classes(_keyed(docs, id_col, text_col), shingle, similarity), "classes")
    first = classes.where("n > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("row"))
    keys = first.select(F.col("row.doc_id").alias("own_id"), F.col("row.digest").alias("own_digest"), F.lit(False).alias("wordless"))
    keys = materialize(keys.union(classes.where("n = 0").select("doc_id", "digest", F.lit(True)).distinct()), "first-of-class")
    size = keys.count()
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"))
    kept = nested.join(F.broadcast(keys) if size <= BROADCAST_IDS else keys, (F.col("digest") == F.col("own_digest")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
    repeated = classes.where("n > 0").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    again = not repeated.isEmpty()
    discard_since(mark, docs.sparkSession, keys)
    if again:
        kept = kept.where("not wordless").dropDuplicates(["doc_id", "digest"]).union(kept.where("wordless"))
    return kept.select("row.*")
