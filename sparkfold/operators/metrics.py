"""Reduction, overhead and report metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import prepare

# Bytes that an index entry takes.
FP_KEY, FP_VALUE, SF_ENTRY, DELTA_ENTRY = 32, 48, 64, 32


def dedup_ratio(chunks: DataFrame, keys: tuple = (), fp: str = "fp", size: str = "chunk_size") -> DataFrame:
    """keys, logical_chunks, unique_chunks, logical_bytes, unique_bytes, dedup_ratio.

    Chunks are put together by fingerprint first, so that no key's rows meet in one task.
    """
    distinct = chunks.groupBy(*keys, fp).agg(F.count("*").alias("n"), F.first(size).alias("one"))
    out = distinct.groupBy(*keys).agg(
        F.sum("n").alias("logical_chunks"), F.count("*").alias("unique_chunks"), F.sum(F.col("n") * F.col("one")).cast("long").alias("logical_bytes"), F.sum("one").cast("long").alias("unique_bytes")
    )
    return out.withColumn("dedup_ratio", F.col("logical_bytes") / F.col("unique_bytes"))


def index_bytes(unique_chunks: Column, distinct_features: Column, delta_keys: Column, delta_edges: Column) -> dict[str, Column]:
    return {"fp_bytes": unique_chunks * (FP_KEY + FP_VALUE), "sf_bytes": distinct_features * SF_ENTRY, "delta_bytes": (delta_keys + delta_edges) * DELTA_ENTRY}


def running_reduction(per_backup: DataFrame, order: str = "backup") -> DataFrame:
    """Adds logical_total, stored_total and reduction: their ratio over the backups so far."""
    so_far = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = per_backup.withColumn("logical_total", F.sum("logical_bytes").over(so_far)).withColumn("stored_total", F.sum("stored_bytes").over(so_far))
    return out.withColumn("reduction", F.col("logical_total") / F.col("stored_total"))


def running_mean(rows: DataFrame, value: str, order: str, out: str) -> DataFrame:
    so_far = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.avg(value).over(so_far))


def last_value(rows: DataFrame, value: str, order: str, keys: tuple = ()) -> DataFrame:
    """keys and the value of the last row in order: what a report quotes from a log."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def byte_counts(rows: DataFrame, payload: str, keys: tuple = ()) -> DataFrame:
    """keys, byte, n: how often a byte stands in the payloads of a key, at most 256 rows per key of an Arrow batch."""
    prepare(rows.sparkSession)
    narrow = rows.select(*keys, F.col(payload).cast("binary").alias("_payload"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("byte", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            first: dict[tuple, int] = {}
            counts: dict[int, np.ndarray] = {}
            named = zip(*[batch.column(c).to_pylist() for c in range(len(keys))], strict=True) if keys else [()] * batch.num_rows
            for i, (key, data) in enumerate(zip(named, batch.column(len(keys)), strict=True)):
                if data.is_valid:
                    at = first.setdefault(key, i)
                    counts[at] = counts.get(at, 0) + np.bincount(np.frombuffer(data.as_buffer(), np.uint8), minlength=256)
            which = [(at, b) for at, c in counts.items() for b in np.flatnonzero(c).tolist()]
            take = pa.array([at for at, _ in which], pa.int64())
            columns = [batch.column(c).take(take) for c in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([b for _, b in which], pa.int32()), pa.array([int(counts[at][b]) for at, b in which], pa.int64())], schema.names)

    return narrow.mapInArrow(run, schema)


def saved_per_call(saved: Column, calls: Column, containers: Column) -> Column:
    """KiB saved per call that crosses the boundary; each container that is written takes one more."""
    return saved / (calls + containers) / 1024


def byte_entropy(rows: DataFrame, payload: str, keys: tuple = ()) -> DataFrame:
    """keys, n_bytes, distinct_bytes, entropy: Shannon entropy of the bytes, to the base of their distinct number (0 for one)."""
    counts = byte_counts(rows, payload, keys).groupBy(*keys, "byte").agg(F.sum("n").alias("n"))
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("n_bytes"), F.count("*").alias("distinct_bytes"), F.sum(F.col("n") * F.log("n")).alias("_s"))
    nats = F.log(F.col("n_bytes").cast("double")) - F.col("_s") / F.col("n_bytes")
    return sums.select(*keys, "n_bytes", "distinct_bytes", F.when(F.col("distinct_bytes") > 1, nats / F.log(F.col("distinct_bytes").cast("double"))).otherwise(0.0).alias("entropy"))
