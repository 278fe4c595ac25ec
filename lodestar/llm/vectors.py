"""What the two vector searches share: which vectors take part, and how blocks of queries meet blocks of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = True) -> DataFrame:
    """``vec_id, v`` (doubles) of rows with an id and a vector of finite numbers; ``zero``: all-zero ones too."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), bad.alias("bad"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.col("bad") & (F.size("v") > 0))
    return (rows if zero else rows.where(F.exists("v", lambda x: x != 0))).select("vec_id", "v")


def pack_blocks(rows: DataFrame, size: int, label: str, change: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``block, size, ids, x``: rows dealt by a hash into blocks of about ``size``, one binary row for each dimension there."""

    def pack(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        dims, ids, out = pc.list_value_length(v).to_numpy(), table.column("vec_id").to_numpy(), []
        for d in np.unique(dims):
            x = v.filter(pa.array(dims == d)).flatten().to_numpy(zero_copy_only=False)
            out.append((table.column("block")[0].as_py(), int(d), ids[dims == d].astype("<i8").tobytes(), (change(x) if change else x).astype("<f8").tobytes()))
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("block", pa.int64()), ("size", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())))})

    blocks = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long"))
    return materialize(dealt.groupBy("block").applyInArrow(pack, "block long, size int, ids binary, x binary"), label)


def meetings(ranges: DataFrame, asked: DataFrame) -> DataFrame:
    """``size, ids, x, q_ids, q_x``: every block of queries with every block of vectors of its dimension, dealt evenly."""
    asked = asked.select(F.col("block").alias("q_block"), "size", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    numbers = (asked.agg(F.max("q_block")).first()[0] or 0) + 1
    told = ranges.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbers - 1).cast("long"))))
    met = told.join(asked, ["q_block", "size"]).select("size", "ids", "x", "q_ids", "q_x")
    return met.repartition(max(1, numbers * ranges.count()))


def best_of(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The first ``k`` of each query's results in ``order``, ties to smaller ids."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
