"""Packing stored chunks into containers of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import container_name
from ..runtime import prepare

# A container's size, and what a record adds to its chunk.
CAPACITY, ADDRESS, DIGESTS, VECTOR = 4 << 20, 144, 128, 16
#: What a record adds where it carries its digests and address, and in the layout without a header.
RECORD, PLAIN_RECORD = ADDRESS + DIGESTS + VECTOR, VECTOR


def pack_approximately(chunks: DataFrame, order: tuple, size: str = "stored_len", streams: tuple = (), capacity: int = CAPACITY) -> DataFrame:
    """Adds container (number from 0): running size over capacity, by a window of built-in functions.

    A chunk that crosses a boundary counts to the container in which it begins.
    """
    running = Window.partitionBy(*(streams or (F.lit(0),))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("container", F.floor((F.sum(size).over(running) - F.col(size)) / capacity))


def pack_exactly(chunks: DataFrame, order: tuple, size: str = "stored_len", streams: tuple = ("backup_id",), capacity: int = CAPACITY, record: int = RECORD) -> DataFrame:
    """Adds container (number from 0 in its stream) and offset, as a writer fills them one after the other.

    A chunk goes to the open container while its record (its bytes and ``record`` more) leaves it below
    capacity, else to a new one. The fill depends on all earlier chunks of the stream, so a stream
    goes through one task, in order, as rows of its key and sizes alone; batches pass one at a time. A
    long stream is cut into several by a further column of ``streams``, each with a container open of its own.
    """
    prepare(chunks.sparkSession)
    chunks = chunks.drop("container", "offset")
    narrow = chunks.select(*streams, *[c for c in order if c not in streams], F.col(size).cast("long").alias(size))
    schema = T.StructType([*narrow.schema.fields, T.StructField("container", T.LongType()), T.StructField("offset", T.LongType())])
    ordered = narrow.repartition(*streams).sortWithinPartitions(*streams, *order)
    n_keys = len(streams)

    def run(batches):
        key, used, container = None, 0, 0
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(n_keys)], strict=True))
            records = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64) + record
            containers, offsets = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
            edges = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]] + [len(keys)]
            for at, end in zip(edges, edges[1:]):  # the rows of one stream
                if keys[at] != key:
                    key, used, container = keys[at], 0, 0
                upto = np.cumsum(records[at:end])
                done = 0
                while done < end - at:  # as many as leave the open container below capacity; one at least in a new one
                    before = upto[done - 1] if done else 0
                    stop = int(np.searchsorted(upto, before + capacity - used))
                    if stop <= done and used:
                        used, container = 0, container + 1
                        continue
                    stop = max(stop, done + 1)
                    containers[at + done : at + stop] = container
                    offsets[at + done : at + stop] = upto[done:stop] - records[at + done : at + stop] - before + used
                    used += int(upto[stop - 1] - before)
                    done = stop
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(containers), pa.array(offsets)], schema.names)

    packed = ordered.mapInArrow(run, schema).drop(size)
    return chunks.join(packed, [*streams, *[c for c in order if c not in streams]])


def container_id(number: Column) -> Column:
    """The name of the n-th container; numbers start at 1."""
    return container_name(number)


def dead_bytes(extents: DataFrame) -> DataFrame:
    """container_id, dead: bytes of the extents that a container no longer needs."""
    return extents.groupBy("container_id").agg(F.sum("length").alias("dead"))


def compact(containers: DataFrame, dead: DataFrame) -> DataFrame:
    """Live records (container_id, offset, length) without the dead ones, moved together in order of offset."""
    live = containers.join(dead.select("container_id", "offset"), ["container_id", "offset"], "left_anti")
    before = Window.partitionBy("container_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return live.withColumn("offset", F.sum("length").over(before) - F.col("length"))


def merge_pairs(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, merged_into: neighbours by name that fit into one container together.

    From the first on, a container takes the next if both are below capacity - 1, and the pair is
    passed over. The walk depends on all earlier pairs, so it goes through one task, as names and sizes alone;
    their number is that of the small containers of one commit.
    """
    prepare(sizes.sparkSession)

    def run(batches):
        names, into, last = [], [], None
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last and last[1] + size < capacity - 1:
                    names += [last[0], name]
                    into += [last[0], last[0]]
                    last = None
                else:
                    if last:
                        names.append(last[0])
                        into.append(last[0])
                    last = (name, size)
        if last:
            names.append(last[0])
            into.append(last[0])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(into, pa.string())], ["container_id", "merged_into"])

    ordered = sizes.select("container_id", F.col("bytes").cast("long")).repartition(1).sortWithinPartitions("container_id")
    return ordered.mapInArrow(run, "container_id string, merged_into string")
