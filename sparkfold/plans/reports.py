"""The logs of a store as DataFrames, and as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

MIB = 1 << 20


def server_log(store: Store) -> DataFrame:
    """Per ingest: speed and seconds, their mean so far, bytes in and stored then, seconds of the pass after it, and the ratio so far."""
    so_far = Window.partitionBy(F.lit(0)).orderBy("commit").rowsBetween(Window.unboundedPreceding, 0)
    times = store.table("timings")
    online = times.filter("kind = 'ingest'").select("commit", F.col("seconds").alias("online_s"))
    passes = times.filter("kind = 'pass'").select((F.col("commit") - 1).alias("commit"), F.col("seconds").alias("offline_s"))
    after = store.table("passes").select((F.col("commit") - 1).alias("commit"), F.col("stored_after"))
    rows = store.table("metrics").join(online, "commit").join(passes, "commit", "left").join(after, "commit", "left")
    rows = rows.withColumn("added", F.col("base_bytes") + F.col("delta_bytes")).withColumn("stored_online", F.sum("added").over(so_far))
    stored = F.coalesce("stored_after", "stored_online")
    return rows.select(
        "commit", "backup_id", (F.col("logical_bytes") / MIB / F.col("online_s")).alias("mib_per_s"), "online_s", F.avg("online_s").over(so_far).alias("mean_online_s"), "logical_bytes", "stored_online",
        F.coalesce("offline_s", F.lit(0.0)).alias("offline_s"), F.avg(F.coalesce("offline_s", F.lit(0.0))).over(so_far).alias("mean_offline_s"), stored.alias("stored_after"),
        (F.sum("logical_bytes").over(so_far) / stored).alias("reduction"),
    )


def chunk_log(store: Store) -> DataFrame:
    """Chunks and bytes so far: logical, unique, bases, deltas, and what compression and deltas saved."""
    so_far = Window.partitionBy(F.lit(0)).orderBy("commit").rowsBetween(Window.unboundedPreceding, 0)
    names = ("logical_chunks", "unique_chunks", "base_chunks", "delta_chunks", "logical_bytes", "unique_bytes", "base_bytes", "delta_bytes", "lz4_saved", "delta_saved")
    return store.table("metrics").select("commit", "backup_id", *[F.sum(c).over(so_far).alias(c) for c in names])


def index_log(store: Store) -> DataFrame:
    return store.overhead()


def reduction_log(store: Store) -> DataFrame:
    """Bytes that deltas saved: inline, the same per coded chunk in KiB, and by offline passes, with what these coded."""
    inline = store.table("metrics").agg(F.sum("delta_saved").alias("inline_saved"), F.sum("delta_chunks").alias("inline_coded"))
    offline = store.table("passes").agg(F.coalesce(F.sum(F.col("stored_before") - F.col("stored_after")), F.lit(0)).alias("offline_saved"), F.coalesce(F.sum("rewritten"), F.lit(0)).alias("rewritten"), F.coalesce(F.sum("recoded"), F.lit(0)).alias("recoded"))
    per = F.when(F.col("inline_coded") > 0, F.col("inline_saved") / F.col("inline_coded") / 1024)
    return inline.crossJoin(offline).withColumn("inline_saved_kib_per_chunk", per)  # one row by one row


def locality_log(store: Store) -> DataFrame:
    """Per ingest the similar chunks that were coded, and those deferred."""
    return store.table("metrics").select("commit", "backup_id", "delta_chunks", "deferred_chunks")


def stage_log(store: Store) -> DataFrame:
    """Milliseconds per MiB of ingests so far."""
    so_far = Window.partitionBy(F.lit(0)).orderBy("commit").rowsBetween(Window.unboundedPreceding, 0)
    rows = store.table("metrics").join(store.table("timings").filter("kind = 'ingest'").select("commit", "seconds"), "commit")
    return rows.select("commit", "backup_id", (F.sum("seconds").over(so_far) * 1000 / (F.sum("logical_bytes").over(so_far) / MIB)).alias("ms_per_mib"))


LOGS = {"server": server_log, "chunk": chunk_log, "index": index_log, "reduction": reduction_log, "locality": locality_log, "stage": stage_log}


def write_logs(store: Store, path: str) -> None:
    """Each log as a folder of CSV with a header."""
    for name, log in LOGS.items():
        log(store).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}-log")
