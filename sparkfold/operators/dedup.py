"""Exact deduplication and the analytics of fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 128


def first_occurrences(chunks: DataFrame, order: tuple, fp: str = "fp") -> DataFrame:
    """One row per fingerprint: that of its earliest place in ``order``.

    An aggregate, not a window: a fingerprint that a third of all rows have is combined before the shuffle.
    """
    place = F.struct(*order)
    rest = [c for c in chunks.columns if c != fp]
    return chunks.groupBy(fp).agg(F.min_by(F.struct(*rest), place).alias("_row")).select(fp, "_row.*")


def batch_flags(chunks: DataFrame, stream: tuple, seq: str = "seq", batch: int = BATCH, fp: str = "fp") -> DataFrame:
    """Adds batch and repeated: whether an earlier chunk of the same batch has the fingerprint."""
    rows = chunks.withColumn("batch", F.floor(F.col(seq) / batch))
    earlier = Window.partitionBy(*stream, "batch", fp).orderBy(seq)
    return rows.withColumn("repeated", F.row_number().over(earlier) > 1)


def new_chunks(chunks: DataFrame, stored: DataFrame, fp: str = "fp") -> DataFrame:
    return chunks.join(stored.select(fp), fp, "left_anti")


def known_chunks(chunks: DataFrame, stored: DataFrame, fp: str = "fp") -> DataFrame:
    return chunks.join(stored.select(fp), fp, "left_semi")


def probe(chunks: DataFrame, stored: DataFrame, hot: DataFrame | None = None, hot_rows: int = 100_000, fp: str = "fp") -> DataFrame:
    """chunks with ``duplicate``: whether stored has their fingerprint.

    With ``hot`` (the most frequent fingerprints) of at most ``hot_rows`` rows, these are answered by
    a broadcast and the others by a join; a larger one is left to the join. The answer is the same.
    """
    known = stored.select(fp).distinct().withColumn("_known", F.lit(True))
    if hot is not None and hot.limit(hot_rows + 1).count() <= hot_rows:
        top = F.broadcast(hot.select(fp).distinct().join(known, fp, "left").withColumnsRenamed({"_known": "_top"}).withColumn("_hot", F.lit(True)))
        marked = chunks.join(top, fp, "left")
        cold = marked.filter("_hot is null").join(known, fp, "left").withColumn("duplicate", F.col("_known").isNotNull())
        warm = marked.filter("_hot is not null").withColumn("duplicate", F.col("_top").isNotNull())
        return warm.select(*chunks.columns, "duplicate").unionByName(cold.select(*chunks.columns, "duplicate"))
    return chunks.join(known, fp, "left").withColumn("duplicate", F.col("_known").isNotNull()).drop("_known")


def frequencies(chunks: DataFrame, fp: str = "fp") -> DataFrame:
    return chunks.groupBy(fp).agg(F.count("*").alias("freq"))


def top_k(chunks: DataFrame, k: int, fp: str = "fp") -> DataFrame:
    """The k most frequent fingerprints, ties to the smaller one."""
    return frequencies(chunks, fp).orderBy(F.desc("freq"), fp).limit(k)


def sketch_counts(chunks: DataFrame, depth: int = 4, width: int = 262_144, fp: str = "fp") -> DataFrame:
    """Cells of the count-min sketch of fingerprints: sketch_row, position, cell."""
    from ..functions.scalars import sketch_positions

    cells = chunks.select(F.posexplode(sketch_positions(F.col(fp), depth, width)).alias("sketch_row", "position"))
    return cells.groupBy("sketch_row", "position").agg(F.count("*").alias("cell"))


def running_estimates(chunks: DataFrame, order: tuple, depth: int = 4, width: int = 262_144, fp: str = "fp") -> DataFrame:
    """order, fp and estimate: what the sketch tells of each chunk just after its own update.

    A cell's count so far is that of the chunks up to this one that fall on it; the estimate is the least cell.
    """
    from ..functions.scalars import sketch_positions

    cells = chunks.select(*order, fp, F.posexplode(sketch_positions(F.col(fp), depth, width)).alias("sketch_row", "position"))
    so_far = Window.partitionBy("sketch_row", "position").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("cell", F.count("*").over(so_far)).groupBy(*order, fp).agg(F.min("cell").alias("estimate"))


def sketch_estimates(chunks: DataFrame, depth: int = 4, width: int = 262_144, fp: str = "fp") -> DataFrame:
    """fp, freq, estimate: the least cell of the fingerprint in the sketch, never below its frequency."""
    from ..functions.scalars import sketch_positions

    known = frequencies(chunks, fp)
    places = known.select(fp, "freq", F.posexplode(sketch_positions(F.col(fp), depth, width)).alias("sketch_row", "position"))
    cells = sketch_counts(chunks, depth, width, fp)
    return places.join(cells, ["sketch_row", "position"]).groupBy(fp, "freq").agg(F.min("cell").alias("estimate"))
