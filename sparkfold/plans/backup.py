"""Whole files in and out of a store."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..operators.chunking import ChunkSpec, cdc_chunks, fixed_chunks
from ..runtime import filesystem
from ..sources.streams import files
from .store import Store


def upload(store: Store, path: str, spec: ChunkSpec | int = ChunkSpec(), offline: bool = True) -> dict:
    """Adds each file of a path as a backup of its path, and runs the offline pass (the adaptive policy's). spec: sizes, or a fixed size.

    Returns files, bytes, chunks and seconds.
    """
    began, found, chunks = time.time(), files(store.spark, path), 0
    names = [r["backup_id"] for r in found.select("backup_id").orderBy("backup_id").collect()]  # the files to add, not their content
    for name in names:
        one = found.filter(F.col("backup_id") == name)
        rows = fixed_chunks(one, "payload", spec) if isinstance(spec, int) else cdc_chunks(one, "payload", spec)
        store.ingest(name, rows.select("seq", "chunk"))
        if offline and store.options.policy == "adaptive":
            store.optimize()
        chunks += store.table("recipes").filter(F.col("backup_id") == name).count()
    size = found.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return {"files": len(names), "bytes": size, "chunks": chunks, "seconds": time.time() - began}


def download(store: Store, backup_id: str, target: str) -> dict:
    """Writes a backup to a file; its chunks pass the driver in order, a partition at a time."""
    began, n, size = time.time(), 0, 0
    want = store.table("recipes").filter(F.col("backup_id") == backup_id).count()
    fs, where = filesystem(store.spark, target)
    out = fs.create(where, True)
    try:
        for row in store.restore(backup_id).orderBy("seq").select("chunk").toLocalIterator():
            out.write(bytearray(row.chunk))
            n, size = n + 1, size + len(row.chunk)
    finally:
        out.close()
    if n != want:
        raise ValueError(f"{backup_id}: {n} of {want} chunks restored")
    return {"bytes": size, "chunks": n, "seconds": time.time() - began}
