"""Codecs for payloads as Arrow-batched functions: local compression and delta encoding."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shortest common prefix or suffix, and length of a seed of a copy, that a delta takes from its base.
EDGE, SEED = 16, 16
INSERT = 1 << 31


def compress(data: bytes) -> bytes:
    """LZ4 block of data, or data itself where that is no longer; told apart by the stored length."""
    packed = pa.compress(data, codec="lz4_raw", asbytes=True) if data else data
    return packed if len(packed) < len(data) else data


def expand(stored: bytes, size: int) -> bytes:
    return stored if len(stored) == size else pa.decompress(stored, decompressed_size=size, codec="lz4_raw", asbytes=True)


def delta_encode(target: bytes, base: bytes) -> bytes:
    """Units that build target from base: copies (length, offset) and inserts (length with top bit, bytes).

    A common prefix and suffix longer than EDGE are copied. Between them, places of the target are
    looked up among the base's strings of SEED bytes, taken at every SEED-th byte; a hit is grown to both sides.
    """
    limit = min(len(target), len(base))
    head = _common(target, base, limit)
    head = head if head > EDGE else 0
    tail = _common(target[::-1], base[::-1], limit - head)
    tail = tail if tail > EDGE else 0
    end, base_end = len(target) - tail, len(base) - tail
    units, pending = [], head
    if head:
        units.append((head, 0, None))
    seeds = {base[i : i + SEED]: i for i in range(head, base_end - SEED + 1, SEED)}
    for at in _likely(target, head, end, base, head, base_end):
        place = seeds.get(target[at : at + SEED]) if at >= pending else None
        if place is None:
            continue
        start, from_ = at, place
        while start > pending and from_ > 0 and target[start - 1] == base[from_ - 1]:
            start, from_ = start - 1, from_ - 1
        stop = at + SEED + _common(target[at + SEED : end], base[place + SEED :], min(end - at, len(base) - place) - SEED)
        if start > pending:
            units.append((start - pending, None, target[pending:start]))
        units.append((stop - start, from_, None))
        pending = stop
    if end > pending:
        units.append((end - pending, None, target[pending:end]))
    if tail:
        units.append((tail, base_end, None))
    return b"".join(struct.pack("<II", n, offset) if data is None else struct.pack("<I", n | INSERT) + data for n, offset, data in units)


def weak_hashes(data: bytes, step: int = 1) -> np.ndarray:
    """A 64-bit value of the SEED bytes at every ``step``-th place; equal strings have equal values, so a
    value only proposes what the bytes then decide."""
    if len(data) < SEED:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    places = np.lib.stride_tricks.sliding_window_view(raw, SEED)[::step]
    words = np.ascontiguousarray(places).view("<u8")
    mixed = words[:, 0] * np.uint64(0x9E3779B97F4A7C15) + words[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


def _likely(target: bytes, at: int, end: int, base: bytes, first: int, last: int) -> list[int]:
    """Places from at on whose SEED bytes may be a seed of base[first:last]."""
    seeds, mine = weak_hashes(base[first:last], SEED), weak_hashes(target[at:end])
    return (np.flatnonzero(np.isin(mine, seeds)) + at).tolist() if len(seeds) else []


def delta_decode(delta: bytes, base: bytes) -> bytes:
    out, at = [], 0
    while at < len(delta):
        (n,) = struct.unpack_from("<I", delta, at)
        at += 4
        if n & INSERT:
            n &= ~INSERT
            out.append(delta[at : at + n])
            at += n
        else:
            (offset,) = struct.unpack_from("<I", delta, at)
            at += 4
            out.append(base[offset : offset + n])
    return b"".join(out)


def _common(a: bytes, b: bytes, limit: int) -> int:
    """Length of the common prefix, at most limit, by halving."""
    if limit <= 0:
        return 0
    if a[:limit] == b[:limit]:
        return limit
    low, high = 0, limit
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _each(function, *series):
    return pd.Series([None if any(v is None for v in row) else function(*row) for row in zip(*series, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _compress(data: pd.Series) -> pd.Series:
    return _each(compress, data)


@F.pandas_udf(T.BinaryType())
def _expand(stored: pd.Series, size: pd.Series) -> pd.Series:
    return _each(lambda s, n: expand(s, int(n)), stored, size)


@F.pandas_udf(T.BinaryType())
def _delta(target: pd.Series, base: pd.Series) -> pd.Series:
    return _each(delta_encode, target, base)


@F.pandas_udf(T.BinaryType())
def _patch(delta: pd.Series, base: pd.Series) -> pd.Series:
    return _each(delta_decode, delta, base)


def lz4(payload: Column) -> Column:
    """The payload compressed, or itself where compression saves nothing."""
    return _compress(payload)


def unlz4(stored: Column, size: Column) -> Column:
    return _expand(stored, size)


def delta(target: Column, base: Column) -> Column:
    return _delta(target, base)


def patch(encoded: Column, base: Column) -> Column:
    return _patch(encoded, base)
