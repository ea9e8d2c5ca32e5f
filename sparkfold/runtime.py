"""What operators need of the session: code on the workers, bounded batches, shared scratch folders."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Has the C library return large blocks at once, and Arrow allocate through it.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows in a batch for Python workers; payloads may be long.
ROWS_AT_ONCE = 1000


def prepare(spark: SparkSession) -> SparkSession:
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_AT_ONCE:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str = "work") -> str:
    """A new path below spark.checkpoint.dir, removed when the driver ends; local masters may lack the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/sparkfold"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path, quiet=True)
    return path


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path of any scheme."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str, quiet: bool = False) -> None:
    try:
        fs, where = filesystem(spark, path)
        fs.delete(where, True)
    except Exception:
        if not quiet:  # at exit the gateway may have ended already
            raise


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file in one step: a new file is moved over the old one."""
    fs, where = filesystem(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(aside, where):
        raise OSError(f"could not move {aside} to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = filesystem(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.shaded.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Writes df to a shared folder and reads it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
