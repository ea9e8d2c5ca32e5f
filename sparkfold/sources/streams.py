"""Sources of byte streams: files, text columns, chunk traces, and synthetic data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_bytes
from ..runtime import prepare

# Bytes of a trace's fingerprint prefix, by format, and the largest chunk of a trace.
PREFIX = {"fsl": 6, "ubc": 5}
LARGEST = 16_384


def files(spark: SparkSession, path: str) -> DataFrame:
    """backup_id (the path), payload, size: whole files as byte streams."""
    found = prepare(spark).read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("backup_id"), F.col("content").alias("payload"), F.col("length").alias("size"))


def text_stream(df: DataFrame, text: str = "text", stream: str = "source", order: str = "doc_id") -> DataFrame:
    """stream, order, payload: a text column as UTF-8 bytes; null texts are empty."""
    return df.select(stream, order, as_bytes(F.coalesce(F.col(text), F.lit(""))).alias("payload"))


def numbered(chunks: DataFrame, stream: str, order: tuple) -> DataFrame:
    """Adds ``place``, the number of a chunk in its stream, over rows of keys alone.

    With several columns of order, chunks are numbered within each value of the first, and a stream's
    window sees one row per such value.
    """
    narrow, (first, *rest) = chunks.select(stream, *order), order
    if rest:
        inside = Window.partitionBy(stream, first).orderBy(*rest)
        earlier = Window.partitionBy(stream).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
        shifts = narrow.groupBy(stream, first).agg(F.count("*").alias("_n")).select(F.col(stream).alias("_of"), F.col(first).alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
        placed = narrow.withColumn("place", F.row_number().over(inside) - 1).join(shifts, F.col(stream).eqNullSafe(F.col("_of")) & F.col(first).eqNullSafe(F.col("_at")))
        narrow = placed.select(stream, *order, (F.col("place") + F.col("_shift")).cast("long").alias("place"))
    else:
        narrow = narrow.withColumn("place", (F.row_number().over(Window.partitionBy(stream).orderBy(first)) - 1).cast("long"))
    return chunks.join(narrow, [stream, *order])


def trace(lines: DataFrame, kind: str = "fsl", value: str = "value") -> DataFrame:
    """prefix (hex), size of each line ``aa:bb:..  size``; parts are separated by colons, tabs or spaces.

    Sizes are capped at LARGEST. Lines without the prefix bytes or a size are left out.
    """
    n = PREFIX[kind]
    parts = F.split(F.trim(F.col(value)), r"[:\t\n ]+")
    prefix = F.lower(F.array_join(F.transform(F.slice(parts, 1, n), lambda p: F.lpad(p, 2, "0")), ""))
    rows = lines.filter(F.size(parts) > n).select("*", prefix.alias("prefix"), F.least(F.get(parts, F.lit(n)).try_cast("long"), F.lit(LARGEST)).alias("size"))
    return rows.filter(F.col("prefix").rlike(f"^[0-9a-f]{{{2 * n}}}$") & F.col("size").isNotNull())


def trace_line(fp: Column, size: Column, kind: str = "fsl") -> Column:
    """The line of a trace that ``trace`` reads: the first bytes of a hex fingerprint apart by colons, a tab, the size."""
    digits = [F.substring(fp, 2 * i + 1, 2) for i in range(PREFIX[kind])]
    return F.concat(F.concat_ws(":", *digits), F.lit("\t"), F.least(size, F.lit(LARGEST)).cast("string"))


def write_trace(chunks: DataFrame, path: str, order: tuple, kind: str = "fsl", fp: str = "fp", size: str = "chunk_size") -> None:
    """Writes the chunks as trace files of ordered lines; files follow each other in the order."""
    chunks.select(*order, trace_line(F.col(fp), F.col(size), kind).alias("value")).orderBy(*order).select("value").write.text(path)


def compressible(size: int, ratio: float, seed: bytes) -> bytes:
    """Bytes that compress to about 1 / ratio: random literals between copies, with lengths by a power law."""
    random = np.random.default_rng(list(seed))
    out = bytearray()
    share = 1 / max(ratio, 1.0)
    while len(out) < size:
        literal = max(1, int(random.pareto(1.5) * 16) + 8)
        out += random.integers(0, 256, literal, np.uint8).tobytes()
        copy = int(literal * (1 / share - 1))
        if copy:
            start = int(random.integers(0, len(out)))
            piece = bytes(out[start : start + 64]) or b"\0"
            out += (piece * (copy // len(piece) + 1))[:copy]
    return bytes(out[:size])


def synthetic_payload(prefix: Column, size: Column, ratio: float = 2.0) -> Column:
    """A chunk for a trace line: the prefix's bytes, then compressible bytes that depend on it."""

    @F.pandas_udf(T.BinaryType())
    def make(prefixes: pd.Series, sizes: pd.Series) -> pd.Series:
        rows = []
        for p, n in zip(prefixes, sizes, strict=True):
            head = bytes.fromhex(p)
            rows.append((head + compressible(max(0, int(n) - len(head)), ratio, head))[: int(n)])
        return pd.Series(rows, dtype=object)

    return make(prefix, size)


def mutated(docs: DataFrame, version: int, text: str = "text", every: int = 3, cut: float = 0.5) -> DataFrame:
    """The next version of documents: in every ``every``-th a passage is put in at the share ``cut`` of its text."""
    at = F.floor(F.length(text) * F.lit(cut)).cast("int")
    edit = F.concat(F.substring(F.col(text), F.lit(1), at), F.lit(f" passage {version} of "), F.col("doc_id").cast("string"), F.lit(". "), F.substring(F.col(text), at + 1, F.length(text)))
    return docs.withColumn(text, F.when(F.col("doc_id") % every == version % every, edit).otherwise(F.col(text)))
