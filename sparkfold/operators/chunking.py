"""Splitting byte streams: chunks of fixed size, and content-defined chunks."""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import prepare


#: Bytes back beyond which a rolling value hardly depends, bytes examined at once, and the rolling value's limit.
REACH, SLICE, LIMIT = 64, 1 << 20, 1 << 32


@functools.cache
def gear_table(seed: str = "sparkfold") -> np.ndarray:
    """A pseudo-random value below 2**31 for each byte value, by rule. A rolling value then stays below 2**32."""
    return np.array([int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "little") >> 1 for i in range(256)], np.uint64)


@dataclass(frozen=True)
class ChunkSpec:
    """Sizes of content-defined chunks. Below ``normal`` bytes the strict mask holds, then the loose one."""

    least: int = 4096
    average: int = 8192
    most: int = 16384
    seed: str = "sparkfold"

    @property
    def normal(self) -> int:
        return min(self.average - min(self.average, self.least + math.ceil(self.least / 2)), self.most)

    @property
    def masks(self) -> tuple[int, int]:
        bits = round(math.log2(self.average))
        return (1 << (bits + 1)) - 1, (1 << (bits - 1)) - 1


SMALL = ChunkSpec(256, 512, 1024)


def _candidates(values: np.ndarray, mask: int) -> np.ndarray:
    """Places whose rolling value may have no bit of mask, whatever stood more than REACH bytes before.

    The value is the whole part of the sum of the gear values halved once per byte, here of the last
    64 with 32 binary places: with what that drops, the true value is the result or one more.
    """
    found = []
    for start in range(0, len(values), SLICE):
        from_ = max(0, start - REACH)
        s = values[from_ : start + SLICE] << np.uint64(32)
        for m in (1, 2, 4, 8, 16, 32):
            longer = s.copy()
            longer[m:] += s[:-m] >> np.uint64(m)
            s = longer
        v = s >> np.uint64(32)
        bits = np.uint64(mask)
        at = np.flatnonzero(((v & bits) == 0) | (((v + np.uint64(1)) & bits) == 0)) + from_
        found.append(at[at >= start])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _rolling(values: np.ndarray, first: int, last: int) -> int:
    """The rolling value at byte last when it was 0 before byte first.

    It grows with the value before any byte; where it is the same from the least and the greatest
    value some bytes back, what stood before these does not matter.
    """
    back = REACH
    while True:
        start = max(first, last - back + 1)
        low, high = 0, 0 if start == first else LIMIT - 1
        for g in values[start : last + 1].tolist():
            low, high = (low >> 1) + g, (high >> 1) + g
        if low == high:
            return low
        back *= 4


def cut_points(data: bytes, spec: ChunkSpec = ChunkSpec()) -> list[int]:
    """Ends of the chunks of data.

    The rolling value starts at 0 after ``least`` bytes of a chunk: h = (h >> 1) + gear[byte]. A cut
    follows the first byte at which h has no bit of the mask, or ``most`` bytes. The first REACH
    bytes are tried one by one, later ones where ``_candidates`` has them.
    """
    values, (strict, loose), normal = gear_table(spec.seed)[np.frombuffer(data, np.uint8)], spec.masks, spec.normal
    places = _candidates(values, loose).tolist() if len(data) > spec.least else []
    ends, start, n = [], 0, len(data)
    while start < n:
        stop = min(n, start + spec.most)
        first, end = start + spec.least, stop
        if first < stop:
            mask = lambda at, start=start: strict if at - start < normal else loose
            h, near = 0, min(stop, first + REACH)
            for at, g in enumerate(values[first:near].tolist(), first):
                h = (h >> 1) + g
                if not h & mask(at):
                    end = at + 1
                    break
            else:
                for k in range(bisect.bisect_left(places, near), len(places)):
                    if places[k] >= stop:
                        break
                    if not _rolling(values, first, places[k]) & mask(places[k]):
                        end = places[k] + 1
                        break
        start = end
        ends.append(start)
    return ends


def fixed_chunks(df: DataFrame, payload: str, size: int = 8192, keys: tuple = ()) -> DataFrame:
    """keys, seq, offset, chunk (binary): every ``size`` bytes, the last chunk shorter, by built-in functions alone.

    A null or empty payload has no chunks. The chunks are cut before they become rows, so that no row
    carries the payload beside its chunk.
    """
    data = F.col(payload)
    starts = F.when(F.length(data) > 0, F.sequence(F.lit(0), F.length(data) - 1, F.lit(size)))
    cut = F.transform(starts, lambda at: F.substring(data, at + 1, F.lit(size)))
    rows = df.select(*keys, F.posexplode(cut).alias("seq", "chunk"))
    return rows.select(*keys, F.col("seq").cast("long").alias("seq"), (F.col("seq").cast("long") * size).alias("offset"), "chunk")


def cdc_chunks(df: DataFrame, payload: str, spec: ChunkSpec = ChunkSpec(), keys: tuple = ()) -> DataFrame:
    """keys, seq, offset, chunk: content-defined chunks. A null or empty payload has none."""
    prepare(df.sparkSession)
    rows = df.select(*keys, F.col(payload).cast("binary").alias("_payload"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("seq", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("chunk", T.BinaryType())])

    def run(batches):
        for batch in batches:
            which, seq, offset, chunk = [], [], [], []
            for i, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                start = 0
                for k, end in enumerate(cut_points(data, spec) if data else ()):
                    which.append(i)
                    seq.append(k)
                    offset.append(start)
                    chunk.append(data[start:end])
                    start = end
            take = pa.array(which, pa.int64())
            columns = [batch.column(c).take(take) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq, pa.int64()), pa.array(offset, pa.int64()), pa.array(chunk, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)
