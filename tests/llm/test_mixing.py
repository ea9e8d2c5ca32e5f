import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkfold.llm.mixing import GOLDEN, POINTS, mix, point, schedule, targets


def level(sizes, weights=(5, 2, 1), cap=3):
    """Targets by the stated steps: share by weight, cap, reshare the excess until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = {s for s in rest if share[s] > cap * sizes[s] + 1e-9}
        if not above:
            return {s: cap * sizes[s] if s in capped else share[s] for s in order}
        capped |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 50, "d": 3, None: 10}, {"a": 7}, {"a": 0, "b": 10, "c": 0}, {f"s{i:02d}": i * i for i in range(30)}])
def test_targets_follow_the_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    want = level(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_schedule_ranks_are_gapless_and_spread(spark):
    sources = targets(spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000)], "source string, source_size long"))
    rows = sorted((r.slot, r.order, r.rank) for r in schedule(sources, 20_000).collect())
    assert [r[0] for r in rows] == list(range(1, 20_001))
    seen = defaultdict(int)
    for slot, order, rank in rows:
        assert rank == seen[order]
        seen[order] += 1
        if slot > 50:
            assert abs(seen[0] - slot * 5 / 8) < 6


def test_odd_documents(spark, odd_docs):
    rows = mix(odd_docs).collect()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    assert len(rows) == odd_docs.count()
    sums, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size in texts[r.doc_id] and 0 <= r.taken <= 3 * r.size
        sums[r.source] += r.size
        taken[r.source] += r.taken
    for r in rows:
        assert r.source_size == sums[r.source] and abs(taken[r.source] - r.target) <= max(64 * 4, 0.02 * r.target)
    assert sorted(map(str, rows)) == sorted(map(str, mix(odd_docs).collect()))
    assert mix(odd_docs.limit(0)).count() == 0


def test_a_small_corpus_gets_small_blocks(spark):
    df = spark.createDataFrame([(i, "word " * 5, f"s{i % 4}") for i in range(40)], "doc_id long, text string, source string")
    taken = defaultdict(int)
    for r in mix(df).collect():
        taken[r.source, r.target] += r.taken
    assert all(abs(n - target) <= 4 for (_, target), n in taken.items())


def test_points_of_far_slots(spark):
    slots = [1, 2, 3_474_701_533, 4_000_000_000, (1 << 32) - 1, 1 << 32, 250_000_000_000, (1 << 62) + 12345]
    got = spark.createDataFrame([(s,) for s in slots], "slot long").select("slot", point(F.col("slot")).alias("point")).collect()
    assert {r.slot: r.point for r in got} == {s: s * GOLDEN % POINTS for s in slots}
