"""Dealing vectors and query blocks to tasks, shared by the nearest-neighbour operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_code

#: Rows of a shard and queries of a block: what a task holds at most, at any size of table.
SHARD_ROWS, BLOCK_ROWS = 16_384, 8_192


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, vec (array of doubles) and dim of the rows whose vector has components, all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("vec")).filter("vec_id is not null and size(vec) > 0")
    return rows.filter(F.forall("vec", finite)).withColumn("dim", F.size("vec"))


def deal(rows: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """rows with shard, queries with block, and their numbers. Both are dealt by hash, evenly."""
    ship_code(rows.sparkSession)
    n, q = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-q // BLOCK_ROWS))
    by = lambda m, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    return rows.withColumn("shard", by(shards, 1)), queries.withColumn("block", by(blocks, 2)), shards, blocks


def matrix(column) -> np.ndarray:
    """A list column, of lists of one length, as an array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, vec_id, score) per query: score descending, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
