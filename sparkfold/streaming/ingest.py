"""Structured Streaming: continuous ingest into a store, and deduplication with keyed state."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import as_bytes, fingerprint
from ..operators.chunking import fixed_chunks
from ..plans.store import Options, Store
from ..runtime import filesystem, prepare
from ..sources.streams import numbered


def chunk_stream(spark: SparkSession, path: str, schema: str, text: str = "text", size: int = 512, files_per_batch: int = 64) -> DataFrame:
    """doc_id, seq, fp, chunk_size, chunk of a folder or file of documents, as a stream."""
    reader = prepare(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    fs, where = filesystem(spark, path)
    if fs.getFileStatus(where).isFile():  # a stream watches a folder
        reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    rows = reader.parquet(path)
    chunks = fixed_chunks(rows.select("doc_id", as_bytes(F.col(text)).alias("payload")), "payload", size, ("doc_id",))
    return chunks.select("doc_id", "seq", fingerprint(F.col("chunk")).alias("fp"), F.length("chunk").alias("chunk_size"), "chunk")


def unique_chunks(stream: DataFrame) -> DataFrame:
    """The first chunk of each fingerprint; fingerprints are kept in the state store."""
    return stream.select("fp", "chunk_size").dropDuplicates(["fp"])


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Processes what there is into Parquet, and reads it back."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


#: One writer at a time for the store of a path; a store belongs to one driver.
_WRITERS: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, options: Options = Options(), client: str = "") -> StreamingQuery:
    """Ingests each micro-batch (seq, chunk; with doc_id numbered anew over documents) as a backup of its own,
    named after the client; a repeated batch is passed over. Streams of several clients take turns."""

    def take(batch: DataFrame, number: int) -> None:
        name = f"{client}/batch-{number:09d}" if client else f"batch-{number:09d}"
        if "doc_id" in batch.columns:
            batch = numbered(batch.withColumn("_batch", F.lit(name)), "_batch", ("doc_id", "seq")).select(F.col("place").alias("seq"), "chunk")
        with _WRITERS[path]:
            store = Store(batch.sparkSession, path, options)
            if not store.table("recipes").filter(F.col("backup_id") == name).limit(1).count():
                store.ingest(name, batch)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_streams(streams: dict[str, DataFrame], path: str, checkpoint: str, options: Options = Options()) -> None:
    """Runs a stream per client to its end, each a query with a checkpoint of its own, into one store."""
    running = [ingest_stream(stream, path, f"{checkpoint.rstrip('/')}/{client}", options, client) for client, stream in streams.items()]
    for query in running:
        query.awaitTermination()
