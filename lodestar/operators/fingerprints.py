"""Fingerprints of tables as hash trees: each node hashes the lines of a bounded number of others, the root stands for the whole.

A row's leaf is where the MD5 of its key leads, so the tree is the same however rows are partitioned, no task sees
more than ``FAN`` lines or so, and two tables differ where their nodes do.  What a key's row holds counts: rows that swap
their contents give another root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines under one node, on average; two hexadecimal digits a level.
FAN = 256


def line(columns: list[str]) -> Column:
    """A row as text: each column's name, the length of its value and the value, in order of names; null is told from empty."""
    value = lambda c: F.col(c).cast("string")
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-"))) for c in sorted(columns)])


def _node(of: str) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(of)), "\n").cast("binary"), 256)


def tree(rows: DataFrame, keys: list[str], depth: int | None = None, deepest: int | None = None) -> DataFrame:
    """``level, node, hash`` of the tree of ``rows``, whose ``keys`` tell them apart; the root is level 0 and the empty node.

    ``depth`` follows from the number of rows unless given, so equal tables have equal trees; it is ``deepest`` at most.
    """
    columns = [c for c in rows.columns if c not in keys]
    own = rows.select(F.md5(line(keys)).alias("place"), F.concat_ws(":", line(keys), F.sha2(line(columns).cast("binary"), 256)).alias("line"))
    if depth is None:
        n, depth = rows.count(), 0
        while n > FAN ** (depth + 1) and depth != deepest:
            depth += 1
    nodes = own.groupBy(F.substring("place", 1, 2 * depth).alias("node")).agg(_node("line").alias("hash")) if depth else own.agg(F.lit("").alias("node"), _node("line").alias("hash"))
    levels = [nodes.select(F.lit(depth).alias("level"), "node", "hash")]
    for level in range(depth - 1, -1, -1):
        of = F.concat_ws(":", "node", "hash")
        below = levels[-1].select(F.substring("node", 1, 2 * level).alias("above"), of.alias("line"))
        up = below.groupBy(F.col("above").alias("node")).agg(_node("line").alias("hash")) if level else below.agg(F.lit("").alias("node"), _node("line").alias("hash"))
        levels.append(up.select(F.lit(level).alias("level"), "node", "hash"))
    out = levels[0]
    for own_level in levels[1:]:
        out = out.union(own_level)
    return out


def root(rows: DataFrame, keys: list[str]) -> str:
    """The root of the tree of ``rows``."""
    return tree(rows, keys).where("level = 0").first()["hash"]


def part_marks(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``part, hash``: a mark of the rows of each part, in two levels; ``part`` is what ``part_of`` tells of the keys."""
    columns = [c for c in rows.columns if c not in keys]
    own = rows.select(part_of(keys, parts).alias("part"), F.substring(F.md5(line(keys)), 1, 2).alias("node"), F.concat_ws(":", line(keys), F.sha2(line(columns).cast("binary"), 256)).alias("line"))
    nodes = own.groupBy("part", "node").agg(_node("line").alias("hash"))
    return nodes.select("part", F.concat_ws(":", "node", "hash").alias("line")).groupBy("part").agg(_node("line").alias("hash"))


def part_of(keys: list[str], parts: int) -> Column:
    """The part that a row belongs to."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
