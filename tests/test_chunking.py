import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfold.operators.chunking import SMALL, ChunkSpec, cdc_chunks, cut_points, fixed_chunks, gear_table


def rolling_cuts(data, spec):
    """The stated rule, step by step."""
    gear, (strict, loose) = [int(g) for g in gear_table(spec.seed)], spec.masks
    ends, start = [], 0
    while start < len(data):
        part = data[start : start + spec.most]
        n, i, h, cut = len(part), min(len(part), spec.least), 0, None
        while i < min(spec.normal, n) and cut is None:
            h = ((h >> 1) + gear[part[i]]) % 2**32
            cut = i + 1 if not h & strict else None
            i += 1
        while i < n and cut is None:
            h = ((h >> 1) + gear[part[i]]) % 2**32
            cut = i + 1 if not h & loose else None
            i += 1
        start += cut or n
        ends.append(start)
    return ends


def test_default_sizes_leave_the_strict_mask_unused():
    spec = ChunkSpec()
    assert spec.normal == 2048 and spec.masks == ((1 << 14) - 1, (1 << 12) - 1) and spec.normal < spec.least
    assert SMALL.normal == 128


@settings(max_examples=40)
@given(st.binary(max_size=5000), st.sampled_from([SMALL, ChunkSpec(16, 64, 128), ChunkSpec(8, 256, 1024)]))
def test_cut_points_follow_the_rule(data, spec):
    ends = cut_points(data, spec)
    assert ends == rolling_cuts(data, spec)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == len(data) and all(s <= spec.most for s in sizes) and all(s >= spec.least for s in sizes[:-1])


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 16384, 16385, 40000])
def test_boundary_sizes(size):
    for data in (bytes(size), random.Random(size).randbytes(size)):
        assert cut_points(data) == rolling_cuts(data, ChunkSpec())


def test_cdc_chunks_of_rows_and_shifted_content(spark):
    data = random.Random(1).randbytes(60_000)
    rows = [(1, bytearray(data)), (2, bytearray(b"shift" + data)), (3, bytearray(b"")), (4, None)]
    df = spark.createDataFrame(rows, "id long, payload binary")
    out = cdc_chunks(df, "payload", SMALL, ("id",)).collect()
    for i, want in rows[:2]:
        parts = sorted((r.seq, r.offset, bytes(r.chunk)) for r in out if r.id == i)
        assert b"".join(c for _, _, c in parts) == bytes(want) and [s for s, _, _ in parts] == list(range(len(parts)))
        assert [o for _, o, _ in parts] == [sum(len(c) for _, _, c in parts[:k]) for k in range(len(parts))]
    assert not [r for r in out if r.id > 2]
    shared = {bytes(r.chunk) for r in out if r.id == 1} & {bytes(r.chunk) for r in out if r.id == 2}
    assert len(shared) > 40  # content decides the cuts, so they return after the shift


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdefgh")), (2, bytearray(b"abc")), (3, bytearray(b"")), (4, None)], "id long, payload binary")
    out = [(r.id, r.seq, r.offset, bytes(r.chunk)) for r in fixed_chunks(df, "payload", 3, ("id",)).orderBy("id", "seq").collect()]
    assert out == [(1, 0, 0, b"abc"), (1, 1, 3, b"def"), (1, 2, 6, b"gh"), (2, 0, 0, b"abc")]
    plan = fixed_chunks(df, "payload", 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert fixed_chunks(df, "payload", 3, ("id",)).agg(F.sum(F.length("chunk"))).first()[0] == 11
