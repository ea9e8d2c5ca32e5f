"""Helpers shared by the corpus operators: code shipping, shared scratch tables, word splitting."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Everything that is not a word byte once A-Z is lower-cased: ASCII without digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


#: Has the C library return large blocks at once, and Arrow allocate through it.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows in a batch for Python workers.
ROWS_AT_ONCE = 1000


def ship_code(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder that the driver has it in, bounds the rows
    that a worker gets at once, as texts may be long, and has workers give freed memory back."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_AT_ONCE:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)


#: Emptied by ``tidied``: what operators keep in a worker while a task runs.
CACHES: list[dict] = []


def tidied(batches: Iterable) -> Iterator:
    """The batches of a task; afterwards the worker, which may idle for long, drops its caches."""
    yield from batches
    for cache in CACHES:
        cache.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can trim
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed when the driver ends.

    Where the setting is absent, a local master gets a temporary folder; a cluster is refused,
    because its executors would not see a folder of the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/sparkfold-scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/sparkfold-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the gateway may have ended already; the shared folder is cleared by its owner
        pass


def materialize(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: cuts lineage, survives lost executors.

    ``tasks`` bounds the tasks of the last stage, and so the files, where little data meets many partitions.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame, text: str = "text") -> tuple:
    """Columns that tell rows apart up to identical ones: doc_id and two hashes of the text."""
    return (F.col("doc_id"), F.xxhash64(F.col(text)).alias("_h1"), F.hash(F.col(text), F.lit(7)).alias("_h2"))


class ChunkCoder:
    """Codes white-space separated chunks of texts as integer ids, each distinct chunk of a slice once.

    ``encode`` maps a list of distinct chunks to the ids of each, as little-endian 32-bit bytes. Memory is bounded: texts go
    through in slices of about ``slice_bytes``.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], prepare: Callable[[pa.Array], pa.Array] | None = None, slice_bytes: int = 2 << 20):
        self.encode, self.prepare, self.slice_bytes = encode, prepare or (lambda texts: texts), slice_bytes

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(self.prepare(texts))
        ends = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.dictionary_encode()
        ids = self.encode(_strings(coded.dictionary))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(lengths) - lengths
        codes = coded.indices.to_numpy()
        each = lengths[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(starts[codes] - upto[:-1], each)
        at += np.arange(len(at))
        return flat[at], upto[ends]

    def __call__(self, texts: list[str]):
        """Yields (index, ids) per text, in order; a null text counts as empty."""
        batch, size, first = [], 0, 0
        for i, t in enumerate(texts):
            t = t or ""
            if len(t) > self.slice_bytes:
                yield from self._run(batch, first)
                yield i, np.concatenate([ids for _, ids in self._run(list(_cut(t, self.slice_bytes)), 0)])
                batch, size, first = [], 0, i + 1
                continue
            batch.append(t)
            size += len(t)
            if size >= self.slice_bytes:
                yield from self._run(batch, first)
                batch, size, first = [], 0, i + 1
        yield from self._run(batch, first)

    def _run(self, batch: list[str], first: int):
        if batch:
            flat, ends = self._slice(pa.array(batch, pa.large_string()))
            for k in range(len(batch)):
                yield first + k, flat[ends[k] : ends[k + 1]]


def _strings(chunks: pa.Array) -> list[str]:
    """Chunks, which hold no line feed, as a list: much faster than one value at a time."""
    if not len(chunks):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks.cast(pa.string())), "\n")
    return joined[0].as_py().split("\n")


def _cut(text: str, size: int):
    """Pieces of text of at least size characters that end at a space, whatever its length."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end
