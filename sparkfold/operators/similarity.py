"""Similar chunks: an index of super-features, the choice of a base, and what a batch may do with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_index(bases: DataFrame, fp: str = "fp", sf: str = "sf", order: str = "insert_seq") -> DataFrame:
    """slot, feature, fp, order: the super-features of the chunks that may be bases."""
    return bases.select(F.col(fp).alias("base_fp"), F.col(order).alias("base_order"), F.posexplode(sf).alias("slot", "feature"))


def index_owners(index: DataFrame) -> DataFrame:
    """The earliest base of each (slot, feature)."""
    return index.groupBy("slot", "feature").agg(F.min_by("base_fp", F.struct("base_order", "base_fp")).alias("base_fp"))


def choose_base(chunks: DataFrame, owners: DataFrame, fp: str = "fp", sf: str = "sf", least_bytes: int = 0, size: str = "chunk_size") -> DataFrame:
    """fp, base_fp, slot: the owner of the chunk's first slot that has one; chunks without are left out.

    ``least_bytes`` keeps chunks too short for features apart, as all of them look alike.
    """
    rows = chunks.filter(F.col(size) >= least_bytes).select(fp, F.posexplode(sf).alias("slot", "feature"))
    hits = rows.join(owners, ["slot", "feature"]).filter(F.col(fp) != F.col("base_fp"))
    return hits.groupBy(fp).agg(F.min(F.struct("slot", "base_fp")).alias("_hit")).select(fp, "_hit.base_fp", "_hit.slot")


def may_be_delta(chunks: DataFrame, plain_prefix: str | None = None, fp: str = "fp") -> DataFrame:
    """The new chunks that may look for a base: all, but those whose fingerprint has the prefix of plain ones."""
    return chunks.filter(~F.col(fp).startswith(plain_prefix)) if plain_prefix else chunks


def swap_owners(index: DataFrame, pairs: DataFrame, digests: DataFrame) -> DataFrame:
    """The index (slot, feature, base_fp, base_order) after new chunks took the places of old ones.

    pairs has old_fp and new_fp; digests has fp, insert_seq, slot, feature of both. All places of old and of
    new ones are cleared, whoever owns them, then the new ones are entered.
    """
    new = pairs.select(F.col("new_fp").alias("fp")).distinct()
    ends = pairs.select(F.col("old_fp").alias("fp")).unionByName(new).distinct()
    cleared = index.join(digests.join(ends, "fp", "left_semi").select("slot", "feature").distinct(), ["slot", "feature"], "left_anti")
    owners = digests.join(new, "fp", "left_semi")
    return cleared.unionByName(owners.select("slot", "feature", F.col("fp").alias("base_fp"), F.col("insert_seq").alias("base_order")))


def greedy_share(ranked: DataFrame, total: int, alpha: float) -> DataFrame:
    """The pairs (rank, saved) worked on while more than alpha of the stored bytes is left, in order of rank.

    Bytes left before a pair are the total less what earlier pairs saved. Earlier ones are summed by
    thousands of ranks, then within a thousand.
    """
    rows = ranked.withColumn("_run", F.floor(F.col("rank") / 1000))
    runs = rows.groupBy("_run").agg(F.sum("saved").alias("_s"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_run", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_run").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(runs, "_run").withColumn("left", F.lit(total) - F.col("_shift") - F.coalesce(F.sum("saved").over(inside), F.lit(0)))
    return rows.filter(F.col("left") > F.lit(alpha * total)).drop("_run", "_shift")


def poor_locality(n: Column, containers: Column, threshold: float = 0.03) -> Column:
    """Whether a batch of n chunks needs more distinct base containers than the whole part of n * threshold."""
    return containers > F.floor(n * F.lit(threshold))


def batch_locality(chunks: DataFrame, stream: tuple = ("backup_id",), container: str = "base_container", threshold: float = 0.03) -> DataFrame:
    """stream, batch, n, containers, deferred: one row per batch."""
    counted = chunks.groupBy(*stream, "batch").agg(F.count("*").alias("n"), F.count_distinct(container).alias("containers"))
    return counted.withColumn("deferred", poor_locality(F.col("n"), F.col("containers"), threshold))


def with_affinity(chunks: DataFrame, stream: tuple = ("backup_id",), container: str = "base_container", threshold: int = 3) -> DataFrame:
    """Adds ``affine``: whether more than ``threshold`` chunks of the batch have their base in this container."""
    together = Window.partitionBy(*stream, "batch", container)
    return chunks.withColumn("affine", F.col(container).isNotNull() & (F.count("*").over(together) > threshold))


def latest_bases(pending: DataFrame) -> DataFrame:
    """old_fp, new_fp, n: deferred pairs (old_fp, new_fp, batch_seq, pair_seq) made a star.

    The last new chunk of an old base takes its place; earlier new ones become pairs of (earlier, last).
    n is the number of pairs that the old base had.
    """
    last = pending.groupBy("old_fp").agg(F.max_by("new_fp", F.struct("batch_seq", "pair_seq")).alias("last_fp"), F.count("*").alias("n"))
    joined = pending.join(last, "old_fp")
    stars = joined.filter("new_fp <> last_fp").select(F.col("new_fp").alias("old_fp"), F.col("last_fp").alias("new_fp"), F.lit(0).cast("long").alias("n"))
    return last.select("old_fp", F.col("last_fp").alias("new_fp"), "n").unionByName(stars).filter("old_fp <> new_fp").distinct()


def rank_pairs(pairs: DataFrame) -> DataFrame:
    """Adds ``rank``: pairs whose old base had most pairs first. One order over all pairs, of keys alone."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "old_fp", "new_fp")))
