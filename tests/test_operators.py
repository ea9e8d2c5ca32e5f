import random
from collections import Counter

from pyspark.sql import functions as F

from sparkfold.operators import containers, dedup, metrics, similarity
from sparkfold.plans.catalog import QUERIES
from sparkfold.sources.streams import compressible, files, mutated, numbered, trace, write_trace


def chunk_rows(spark, n=400, kinds=60):
    r = random.Random(2)
    rows = [("s", i, f"{r.randrange(kinds):064x}" if i % 3 else f"{0:064x}", 10 + i % 7) for i in range(n)]
    return rows, spark.createDataFrame(rows, "stream string, seq long, fp string, chunk_size long")


def test_first_occurrences_frequencies_and_probe(spark):
    rows, df = chunk_rows(spark)
    first = {}
    for _, i, fp, _ in rows:
        first.setdefault(fp, i)
    assert {r.fp: r.seq for r in dedup.first_occurrences(df, ("seq",)).collect()} == first
    counts = Counter(fp for _, _, fp, _ in rows)
    assert {r.fp: r.freq for r in dedup.frequencies(df).collect()} == counts
    top = [(r.fp, r.freq) for r in dedup.top_k(df, 5).collect()]
    assert top == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]
    stored = df.filter("seq < 100")
    known = {fp for _, i, fp, _ in rows if i < 100}
    for hot in (None, dedup.top_k(df, 10)):
        out = dedup.probe(df, stored, hot).collect()
        assert len(out) == len(rows) and all(r.duplicate == (r.fp in known) for r in out)
    assert dedup.probe(df, stored, dedup.top_k(df, 10), hot_rows=1).filter("duplicate").count() == sum(fp in known for _, _, fp, _ in rows)


def test_batch_flags(spark):
    rows, df = chunk_rows(spark)
    seen, want = set(), {}
    for _, i, fp, _ in rows:
        key = (i // 128, fp)
        want[i] = key in seen
        seen.add(key)
    assert {r.seq: r.repeated for r in dedup.batch_flags(df, ("stream",)).collect()} == want


def test_sketch_never_underestimates(spark):
    _, df = chunk_rows(spark)
    out = dedup.sketch_estimates(df, width=16).collect()
    assert all(r.estimate >= r.freq for r in out) and any(r.estimate > r.freq for r in out)
    assert all(r.estimate == r.freq for r in dedup.sketch_estimates(df.filter("seq < 1")).collect())


def test_choose_base_takes_the_first_slot_and_the_earliest_owner(spark):
    bases = spark.createDataFrame([("b1", ["x", "y", "z"], 1), ("b2", ["x", "q", "w"], 2), ("b3", ["n", "y", "m"], 0)], "fp string, sf array<string>, insert_seq long")
    asked = spark.createDataFrame([("c1", ["x", "y", "0"], 100), ("c2", ["0", "y", "w"], 100), ("c3", ["0", "0", "w"], 100), ("c4", ["0", "1", "2"], 100), ("b1", ["x", "y", "z"], 100), ("c5", ["x", "0", "0"], 5)], "fp string, sf array<string>, chunk_size long")
    owners = similarity.index_owners(similarity.feature_index(bases))
    got = {r.fp: (r.base_fp, r.slot) for r in similarity.choose_base(asked, owners, least_bytes=10).collect()}
    assert got == {"c1": ("b1", 0), "c2": ("b3", 1), "c3": ("b2", 2), "b1": ("b3", 1)}


def test_locality_threshold_is_a_whole_number(spark):
    rows = [("a", 0, f"c{i % 4}") for i in range(128)] + [("a", 1, f"c{i % 3}") for i in range(128)] + [("a", 2, "c0") for _ in range(33)] + [("a", 3, None) for _ in range(10)]
    out = {r.batch: (r.n, r.containers, r.deferred) for r in similarity.batch_locality(spark.createDataFrame(rows, "backup_id string, batch long, base_container string")).collect()}
    assert out == {0: (128, 4, True), 1: (128, 3, False), 2: (33, 1, True), 3: (10, 0, False)}


def test_affinity_needs_more_than_the_threshold(spark):
    rows = [("a", 0, "x")] * 4 + [("a", 0, "y")] * 3 + [("a", 0, None)] * 5
    out = Counter((r.base_container, r.affine) for r in similarity.with_affinity(spark.createDataFrame(rows, "backup_id string, batch long, base_container string")).collect())
    assert out == {("x", True): 4, ("y", False): 3, (None, False): 5}


def test_latest_bases(spark):
    rows = [("o", "n1", 0, 0), ("o", "n2", 0, 1), ("o", "n3", 1, 0), ("p", "m", 0, 0)]
    out = [(r.old_fp, r.new_fp, r.n, r["rank"]) for r in similarity.rank_pairs(similarity.latest_bases(spark.createDataFrame(rows, "old_fp string, new_fp string, batch_seq long, pair_seq long"))).orderBy("rank").collect()]
    assert out == [("o", "n3", 3, 1), ("p", "m", 1, 2), ("n1", "n3", 0, 3), ("n2", "n3", 0, 4)]


def test_exact_packing_follows_the_writer(spark):
    r = random.Random(1)
    rows = [(s, i, r.randrange(1, 9000)) for s in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "backup_id string, seq long, stored_len long").repartition(5)
    got = {(x.backup_id, x.seq): (x.container, x.offset) for x in containers.pack_exactly(df, ("seq",), capacity=32768).collect()}
    for s in "ab":
        used = number = 0
        for i in range(200):
            n = next(x for a, k, x in rows if (a, k) == (s, i))
            if used and 16 + n + used + 128 + 144 >= 32768:
                used, number = 0, number + 1
            assert got[s, i] == (number, used)
            used += n + 288


def test_approximate_packing(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(10)], "s string, seq long, stored_len long")
    assert [r.container for r in containers.pack_approximately(df, ("seq",), streams=("s",), capacity=25).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]


def test_compaction_and_merging(spark):
    live = spark.createDataFrame([("c", 0, 5), ("c", 5, 7), ("c", 12, 3), ("d", 0, 4)], "container_id string, offset long, length long")
    dead = live.filter("container_id = 'c' and offset = 5")
    assert sorted((r.container_id, r.offset, r.length) for r in containers.compact(live, dead).collect()) == [("c", 0, 5), ("c", 5, 3), ("d", 0, 4)]
    assert containers.dead_bytes(dead).first().dead == 7
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 95), ("d", 20), ("e", 20), ("f", 1)], "container_id string, bytes long")
    assert {r.container_id: r.merged_into for r in containers.merge_pairs(sizes, 100).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "f"}


def test_metrics(spark):
    _, df = chunk_rows(spark)
    r = metrics.dedup_ratio(df.withColumn("chunk_size", F.lit(10).cast("long"))).first()
    assert r.logical_bytes == 4000 and r.unique_bytes == 10 * r.unique_chunks and abs(r.dedup_ratio - 4000 / r.unique_bytes) < 1e-12
    e = metrics.byte_entropy(spark.createDataFrame([("a", bytearray(b"aabb")), ("b", bytearray(b"cccc"))], "k string, p binary"), "p", ("k",)).collect()
    assert {x.k: round(x.entropy, 9) for x in e} == {"a": 1.0, "b": 0.0}
    runs = metrics.running_reduction(spark.createDataFrame([("a", 10, 5), ("b", 10, 1)], "backup string, logical_bytes long, stored_bytes long")).orderBy("backup").collect()
    assert [round(x.reduction, 6) for x in runs] == [2.0, 3.333333]


def test_sources(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert [(bytes(r.payload), r["size"]) for r in files(spark, str(tmp_path)).collect()] == [(b"abc", 3)]
    lines = spark.createDataFrame([("aa:bb:cc:dd:ee:0f 8192",), ("1:2:3:4:5:6\t99999",), ("bad line",), ("",), ("aa:bb:cc:dd:ee:zz 5",)], "value string")
    assert [(r.prefix, r["size"]) for r in trace(lines).collect()] == [("aabbccddee0f", 8192), ("010203040506", 16384)]
    import pyarrow as pa

    data = compressible(20000, 2.0, b"seed")
    assert len(data) == 20000 and data == compressible(20000, 2.0, b"seed") and 1.4 < 20000 / len(pa.compress(data, codec="lz4_raw", asbytes=True)) < 2.8
    docs = spark.createDataFrame([(i, "some text here") for i in range(6)], "doc_id long, text string")
    assert mutated(docs, 1).filter("text like '%passage 1 of%'").count() == 2
    assert [r.place for r in numbered(spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "s string, k long"), "s", ("k",)).orderBy("s", "k").collect()] == [0, 1, 0]


def test_byte_sums_of_texts_of_any_length(spark, tmp_path):
    texts = ["", "a", "é東京", "x" * 2000, "y" * 2001, "long words " * 20_000]
    spark.createDataFrame([(i, t, "en", "src0") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.bytes_total for r in QUERIES["byte_sums_of_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: sum(t.encode()) % 2**32 for i, t in enumerate(texts)}


def test_exact_packing_equals_a_writer_in_batches_of_any_size(spark):
    r = random.Random(6)
    rows = [(f"s{r.randrange(3)}", i, r.choice([1, 50, 400, 3000])) for i in range(900)]
    df = spark.createDataFrame(rows, "backup_id string, seq long, stored_len long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, record in ((7, containers.RECORD), (1000, containers.PLAIN_RECORD)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = {(x.backup_id, x.seq): (x.container, x.offset) for x in containers.pack_exactly(df, ("seq",), capacity=2048, record=record).collect()}
            state, want = {}, {}
            for s, i, n in rows:
                number, used = state.get(s, (0, 0))
                if used and used + n + record >= 2048:
                    number, used = number + 1, 0
                want[s, i] = number, used
                state[s] = number, used + n + record
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_written_traces_are_read_back(spark, tmp_path):
    _, df = chunk_rows(spark)
    write_trace(df, f"file://{tmp_path}/trace", ("seq",))
    lines = spark.read.text(f"file://{tmp_path}/trace")
    got = sorted((x.prefix, x.size) for x in trace(lines).collect())
    assert got == sorted((x.fp[:12], x.chunk_size) for x in df.collect())


def test_byte_counts_and_running_estimates(spark):
    df = spark.createDataFrame([("a", bytearray(b"aab")), ("a", None), (None, bytearray(b"b")), ("b", bytearray(b""))], "k string, p binary")
    assert sorted(((x.k or "", x.byte, x.n) for x in metrics.byte_counts(df, "p", ("k",)).collect())) == [("", 98, 1), ("a", 97, 2), ("a", 98, 1)]
    rows, chunks = chunk_rows(spark, 60, 10)
    got = {x.seq: x.estimate for x in dedup.running_estimates(chunks, ("seq",)).collect()}
    seen = Counter()
    for _, i, fp, _ in rows:
        seen[fp] += 1
        assert got[i] >= seen[fp]
