"""Mixing sources to target weights along a low-discrepancy schedule.

The mix has as many words as the corpus. It is a sequence of slots of ``block`` words each; slot i
takes its source from the golden-ratio point i * phi mod 1, looked up in the cumulative target
weights, so every source's share of any stretch of the mix is within a few slots of its target.
The documents of a source, in hashed order, form an endless stream that is cut into blocks of
``block`` words; a source's n-th slot (its rank) takes the n-th block. How many words of a document
the mix takes is the sum over the joined slots and blocks. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: 2**32 divided by the golden ratio, and the number of its points.
GOLDEN, POINTS = 2654435769, 1 << 32
#: Slots in a run that is ranked within one task, and cells that the unit interval is joined by.
RUN, CELLS = 8192, 1024
WORDS = r"[^\x20\x09-\x0D]+"
#: A document gives at most so many times its words.
CAP = 3
#: Documents of a source that are ordered within one task.
BUCKET_ROWS = 2000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), cap: int = CAP) -> DataFrame:
    """Words that each source shall give: source, source_size, order, weight, target.

    sizes has a row per source: source, source_size. Sources by code point, null last, weigh
    ``weights`` in turn. Targets in proportion stop at ``cap`` times the source's size; what is above
    goes to the others by weight. With sources in order of size per weight, the common level is
    (words not given to capped sources) / (weight of the others), at the point where it is highest.
    """
    one = Window.partitionBy(F.lit(0))
    ordered = sizes.withColumn("order", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("order") % len(weights) + 1).cast("int"))
    by_level = one.orderBy(F.col("cap") / F.col("weight"), "order")
    level = (F.col("total") - F.col("capped")) / F.col("rest")
    return (
        ordered.withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * cap).cast("double"))
        .withColumn("total", F.sum("source_size").over(one).cast("double"))
        .withColumn("capped", F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("rest", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max(level).over(one))
        .select("source", "source_size", "order", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def point(slot: Column) -> Column:
    """slot * GOLDEN modulo POINTS, by factors so small that no slot number overflows a long."""
    return F.pmod(slot % POINTS * (GOLDEN - POINTS), F.lit(POINTS))


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """The mix's slots: slot (from 1), order (of the source), rank (of the slot in its source).

    sources has order and target. A slot's point is joined to its source's interval by the cell of
    the unit interval that both lie in. Ranks are counted within runs of slots and shifted by the
    counts of earlier runs, so no task sees all slots of a large source.
    """
    spark = sources.sparkSession
    before = F.sum("target").over(Window.partitionBy(F.lit(0)).orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("target").over(Window.partitionBy(F.lit(0)).orderBy("order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    width = POINTS // CELLS
    ends = sources.filter("target > 0").withColumn("hi", F.round(before / all_ * POINTS).cast("long"))
    spans = ends.withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("order")), F.lit(0).cast("long")))
    spans = spans.filter("hi > lo").select("order", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    slots = spark.range(1, n_slots + 1).select(F.col("id").alias("slot"), point(F.col("id")).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / width)).withColumn("run", F.floor(F.col("slot") / RUN))
    drawn = slots.join(spans, "cell").filter("point >= lo and point < hi").select("slot", "run", "order")
    counts = drawn.groupBy("order", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("order").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("order", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    ranked = drawn.withColumn("at", F.row_number().over(Window.partitionBy("order", "run").orderBy("slot")) - 1)
    return ranked.join(counts, ["order", "run"]).select("slot", "order", (F.col("shift") + F.col("at")).alias("rank"))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), block: int = 64, keep: tuple = ()) -> DataFrame:
    """How much of each document the mix takes: doc_id, source, size, source_size, target, taken, *keep.

    docs has doc_id, source, text; ``keep`` names further narrow columns to carry along. ``block`` is
    halved as far as a small corpus needs for 4096 slots. A null text has size 0, a null source is a
    source of its own (last), repeated rows count each, an empty table gives no rows, and equal rows
    tie in any order, which gives the same result. Reruns agree: order and points are hashes.
    """
    size = n_words(F.col("text"))
    sized = materialize(docs.select("doc_id", "source", size.alias("size"), *keep, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_hash")))
    n_rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    while block > 1 and total < 4096 * block:
        block //= 2
    sources = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights))

    # A prefix sum in hashed order, by buckets of the hash: no task sees all rows of a source.
    digits = 1
    while 16**digits * BUCKET_ROWS < n_rows and digits < 7:
        digits += 1
    sized = sized.withColumn("_bucket", F.substring("_hash", 1, digits))
    sums = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    sums = sums.join(sources, sums["source"].eqNullSafe(sources["source"])).select(sums["source"].alias("_s"), sums["_bucket"].alias("_b"), "shift", "order", "source_size", "target")
    inside = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "size", *keep)
    placed = sized.withColumn("_n", F.row_number().over(inside)).withColumn("_upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(sums, placed["source"].eqNullSafe(sums["_s"]) & (placed["_bucket"] == sums["_b"]))
    placed = placed.withColumn("_start", F.col("shift") + F.col("_upto") - F.col("size"))

    slots = schedule(sources, -(-total // block)).withColumnRenamed("order", "_order")
    row = ["doc_id", "source", "size", *keep, "order", "_bucket", "_n", "source_size", "target"]
    # The stream repeats at most CAP times; a block of it covers the words [rank, rank + 1) * block.
    turns = placed.filter("size > 0").withColumn("_lo", F.explode(F.array(*[F.col("_start") + F.col("source_size") * i for i in range(CAP)])))
    turns = turns.filter(F.col("_lo") < F.col("target") + 64 * block).withColumn("_hi", F.col("_lo") + F.col("size"))
    parts = turns.select(*row, "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))).alias("rank"))
    joined = parts.join(slots.select("_order", F.col("rank").alias("_rank")), (F.col("order") == F.col("_order")) & (F.col("rank") == F.col("_rank")))
    words = F.least("_hi", (F.col("rank") + 1) * block) - F.greatest("_lo", F.col("rank") * block)
    taken = joined.select(*row, words.cast("long").alias("taken")).unionByName(placed.select(*row, F.lit(0).cast("long").alias("taken")))
    return taken.groupBy(*row).agg(F.sum("taken").alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken", *keep)
