import random

import pytest
from pyspark.sql import functions as F

from sparkfold.plans.store import POLICIES, Options, Policy, Store, register_policy
from sparkfold.streaming.ingest import ingest_stream, run_to_end, unique_chunks


def versions(n=3):
    r = random.Random(9)
    docs = [r.randbytes(1500) + b"plain text " * 150 for _ in range(30)]
    out = [list(docs)]
    for v in range(1, n):
        docs = list(docs)
        for i in range(v, 30, 3):
            at = r.randrange(len(docs[i]))
            docs[i] = docs[i][:at] + f"edit {v}-{i}".encode() + docs[i][at + 4 :]
        docs.append(r.randbytes(2000))
        out.append(docs)
    return out


def ingest_all(spark, path, options):
    store = Store(spark, path, options)
    for k, docs in enumerate(versions()):
        store.ingest(f"v{k}", spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(docs)], "seq long, chunk binary"))
    return store


def restored(store):
    return {(r.backup_id, r.seq): bytes(r.chunk) for r in store.restore().collect()}


WANT = {(f"v{k}", i): d for k, docs in enumerate(versions()) for i, d in enumerate(docs)}


@pytest.mark.parametrize("policy", tuple(POLICIES))
def test_policies_restore_and_account(spark, tmp_path, policy):
    options = Options(policy=policy, container_bytes=16384, key=b"0123456789abcdef" if policy == "inline" else None, affinity_threshold=1)
    store = ingest_all(spark, f"file://{tmp_path}/store", options)
    assert restored(store) == WANT and store.orphans().count() == 0
    m = store.table("metrics").agg(*[F.sum(c).alias(c) for c in ("unique_bytes", "base_bytes", "delta_bytes", "lz4_saved", "delta_saved", "delta_chunks", "deferred_chunks")]).first()
    assert m.unique_bytes == m.base_bytes + m.delta_bytes + m.lz4_saved + m.delta_saved
    assert (m.delta_chunks > 0) == (policy in ("inline", "container_affinity")) and (m.deferred_chunks > 0) == (policy in ("inline_no_offline", "adaptive"))
    top = store.table("chunks").groupBy("container_id", "is_delta").agg(F.sum(F.col("stored_len") + 288).alias("b")).agg(F.max("b")).first()[0]
    assert top <= 16384 + 144
    again = Store(spark, f"file://{tmp_path}/store", options)
    assert again.manifest == store.manifest and again.table("recipes").count() == len(WANT)
    if policy == "inline":
        assert not store.table("chunks").filter("not is_delta").filter(F.length("payload") == F.col("stored_len")).count()


def test_offline_pass(spark, tmp_path):
    store = ingest_all(spark, f"file://{tmp_path}/store", Options(container_bytes=16384))
    before = store.table("pending").count()
    assert before > 0
    store.optimize()
    log = store.table("passes").first()
    chunks = store.table("chunks")
    deltas = chunks.filter("is_delta")
    assert log.rewritten > 0 and log.stored_after < log.stored_before and store.table("pending").count() == 0
    assert restored(store) == WANT and store.orphans().count() == 0
    assert deltas.join(deltas.select(F.col("fp").alias("base_fp")), "base_fp").count() == 0
    assert chunks.count() == chunks.select("fp").distinct().count()
    # The next version is coded against the newest chunks, and a second pass codes the deltas again.
    want = dict(WANT)
    for k in (3, 4):  # version 4 edits what version 1 did
        docs = versions(5)[k]
        store.ingest(f"v{k}", spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(docs)], "seq long, chunk binary"))
        want.update({(f"v{k}", i): d for i, d in enumerate(docs)})
    store.optimize()
    assert restored(store) == want
    assert store.table("passes").agg(F.sum("recoded")).first()[0] > 0


def test_greedy_share_of_one_changes_the_index_alone(spark, tmp_path):
    store = ingest_all(spark, f"file://{tmp_path}/store", Options(greedy_alpha=1.0))
    index = {(r.slot, r.feature, r.base_fp) for r in store.table("sf_index").collect()}
    store.optimize()
    log = store.table("passes").first()
    assert log.pairs > 0 and log.rewritten == 0 and log.stored_after == log.stored_before
    assert {(r.slot, r.feature, r.base_fp) for r in store.table("sf_index").collect()} != index and restored(store) == WANT


def test_discarding_pending_and_reports(spark, tmp_path):
    store = ingest_all(spark, f"file://{tmp_path}/store", Options())
    store.discard_pending()
    assert store.table("pending").count() == 0
    assert [r.reduction > 0 for r in store.reduction().collect()] == [True] * 3
    sizes = {r.kind: r.bytes for r in store.overhead().collect()}
    assert sizes["fp"] == 80 * store.table("chunks").count() and sizes["sf"] > 0
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/other", Options(policy="none"))


def test_streams(spark, tmp_path):
    rows = [(i, bytearray(f"chunk {i % 7}".encode() * 20)) for i in range(30)]
    spark.createDataFrame(rows, "seq long, chunk binary").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq long, chunk binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest_stream(stream, f"file://{tmp_path}/store", f"{tmp_path}/offsets", Options(policy="dedup_only")).awaitTermination()
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.table("chunks").count() == 7 and store.table("recipes").count() == 30
    assert sorted(bytes(r.chunk) for r in store.restore().collect()) == sorted(bytes(c) for _, c in rows)
    marked = stream.withColumn("fp", F.sha2("chunk", 256)).withColumn("chunk_size", F.length("chunk"))
    assert run_to_end(unique_chunks(marked), f"{tmp_path}/out", f"{tmp_path}/offsets2").count() == 7


def test_chunks_of_a_first_backup_have_bases_in_its_earlier_batches(spark, tmp_path):
    r = random.Random(4)
    first = [r.randbytes(3000) for _ in range(4)]
    docs = [*first, first[0][:2900] + b"x" * 100, *[r.randbytes(500) for _ in range(3)], b"y" * 50 + first[1][50:], first[0][:2900] + b"z" * 100]
    rows = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(docs)], "seq long, chunk binary")
    for own in (True, False):
        store = Store(spark, f"file://{tmp_path}/own-{own}", Options(policy="inline", batch=4, own_bases=own))
        store.ingest("one", rows)
        assert {(x.backup_id, x.seq): bytes(x.chunk) for x in store.restore().collect()} == {("one", i): d for i, d in enumerate(docs)}
        fps = {x.fp: x.seq for x in store.recipes().collect()}
        bases = {fps[x.fp]: fps[x.base_fp] for x in store.table("chunks").filter("is_delta").collect()}
        assert bases == ({4: 0, 8: 1, 9: 0} if own else {})


def test_a_registered_policy_is_used(spark, tmp_path):
    register_policy("first_batch_only", Policy(lambda similar, sizes, options: similar.withColumns({"use": F.col("batch") == 0, "late": F.lit(False)})))
    try:
        store = ingest_all(spark, f"file://{tmp_path}/store", Options(policy="first_batch_only", batch=8))
        assert restored(store) == WANT
        deltas = store.table("chunks").filter("is_delta").join(store.recipes().groupBy("fp").agg(F.min("seq").alias("seq")), "fp")
        assert 0 < deltas.count() == deltas.filter("seq < 8").count()
    finally:
        POLICIES.pop("first_batch_only")
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/other", Options(policy="first_batch_only"))


def test_the_sketch_is_remembered(spark, tmp_path):
    from sparkfold.operators.dedup import sketch_counts

    path = f"file://{tmp_path}/store"
    store = Store(spark, path, Options(policy="dedup_only", key=b"0123456789abcdef"))
    for k, docs in enumerate(versions(2)):
        store.ingest(f"v{k}", spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(docs)], "seq long, chunk binary"))
        store.remember()
    rows = lambda df: {(x.sketch_row, x.position): x.cell for x in df.collect()}
    assert rows(Store(spark, path, store.options).sketch()) == rows(sketch_counts(store.recipes())) != {}
    assert store.table("recipes").join(store.table("chunks"), "fp").count() == 0  # stored encrypted
