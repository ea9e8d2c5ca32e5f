"""A reduction store of backups on Parquet: ingest under a policy, restore, and an offline pass.

Tables are lists of Parquet folders named by a manifest. A commit writes new folders, then replaces the
manifest, so readers see whole versions and a failed commit leaves the old one. One writer at a time;
inside a commit all work is parallel.

A chunk may be coded against a base of an earlier commit, or of an earlier batch of its own backup: there
against the chunks that are like no earlier one, which are sure to be stored as bases (both are
deterministic forms of "already written"). Index joins move fingerprints and digests; payloads are joined last, for the chunks that need them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import delta, lz4, patch, unlz4
from ..functions.scalars import container_name, decrypt, encrypt, fingerprint
from ..functions.superfeatures import super_feature
from ..operators.containers import merge_pairs, pack_exactly
from ..operators.dedup import BATCH, first_occurrences, new_chunks, sketch_counts
from ..operators.similarity import choose_base, feature_index, greedy_share, index_owners, latest_bases, may_be_delta, poor_locality, rank_pairs, swap_owners
from ..runtime import keep, prepare, read_text, write_text


def _always(similar: DataFrame, sizes: DataFrame, options: Options) -> DataFrame:
    return similar.withColumns({"use": F.lit(True), "late": F.lit(False)})


def _affine(similar: DataFrame, sizes: DataFrame, options: Options) -> DataFrame:
    """Deltas only where a batch needs a container often."""
    together = Window.partitionBy("batch", "base_container")
    return similar.withColumn("use", F.count("*").over(together) > options.affinity_threshold).withColumn("late", F.lit(False))


def _local(similar: DataFrame, sizes: DataFrame, options: Options) -> DataFrame:
    """Deltas in batches of good locality; the similar chunks of others are late."""
    needs = similar.groupBy("batch").agg(F.count_distinct("base_container").alias("containers"))
    poor = needs.join(sizes, "batch").select("batch", poor_locality(F.col("n"), F.col("containers"), options.locality_threshold).alias("late"))
    return similar.join(poor, "batch").withColumn("use", ~F.col("late"))


@dataclass(frozen=True)
class Policy:
    """What becomes of similar chunks. ``mark`` adds to similar (fp, batch, base_fp, base_container) whether a
    delta is tried (use) and whether the chunk is stored as a base that is no base for others yet (late);
    sizes has batch and n, its chunks. Without mark there are no deltas. ``offline``: late pairs wait for
    the offline pass."""

    mark: Callable[[DataFrame, DataFrame, Options], DataFrame] | None
    offline: bool = False


#: The policies by name; ``register_policy`` adds to them.
POLICIES: dict[str, Policy] = {
    "dedup_only": Policy(None),
    "inline": Policy(_always),
    "inline_no_offline": Policy(_local),
    "container_affinity": Policy(_affine),
    "adaptive": Policy(_local, offline=True),
}


def register_policy(name: str, policy: Policy) -> None:
    POLICIES[name] = policy


SCHEMAS = {
    "recipes": "backup_id string, seq long, fp string",
    "chunks": "fp string, is_delta boolean, base_fp string, container_id string, offset long, stored_len long, logical_len long, sf array<string>, deferred boolean, commit int, insert_seq long, payload binary",
    "sf_index": "slot int, feature string, base_fp string, base_order long",
    "pending": "old_fp string, new_fp string, batch_seq long, pair_seq long",
    "metrics": "commit int, backup_id string, logical_chunks long, unique_chunks long, base_chunks long, delta_chunks long, deferred_chunks long, "
    "logical_bytes long, unique_bytes long, base_bytes long, delta_bytes long, lz4_saved long, delta_saved long",
    "timings": "commit int, kind string, backup_id string, seconds double",
    "sketch": "commit int, sketch_row int, position long, cell long",
    "passes": "commit int, pairs long, rewritten long, recoded long, stored_before long, stored_after long",
}


@dataclass(frozen=True)
class Options:
    policy: str = "adaptive"
    batch: int = BATCH
    locality_threshold: float = 0.03
    affinity_threshold: int = 3
    greedy_alpha: float = 0.0
    container_bytes: int = 4 << 20
    least_similar_bytes: int = 0
    #: Whether chunks may have bases in earlier batches of their own backup.
    own_bases: bool = True
    #: Batches whose chunks go to containers in one task.
    span: int = 4096
    #: Chunks whose fingerprint begins so are never coded as deltas; none by default.
    plain_prefix: str | None = None
    key: bytes | None = None


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        if options.policy not in POLICIES:
            raise ValueError(f"policy must be one of {tuple(POLICIES)}")
        self.spark, self.path, self.options = prepare(spark), path.rstrip("/"), options
        text = read_text(spark, f"{self.path}/MANIFEST")
        self.manifest = json.loads(text) if text else {"commit": 0, "tables": {}}

    def table(self, name: str) -> DataFrame:
        paths = self.manifest["tables"].get(name)
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def _write(self, name: str, df: DataFrame) -> tuple[str, DataFrame]:
        """Writes a folder of the next commit: its path, and df read back."""
        path = f"{self.path}/{name}/{self.manifest['commit'] + 1:06d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def _commit(self, added: dict[str, DataFrame | str], replaced: dict[str, DataFrame | str] | None = None) -> None:
        """A new version with what is added, or stands in for a whole table: rows, or the path of a written folder."""
        tables = {k: list(v) for k, v in self.manifest["tables"].items()}
        changes = [(name, rows, False) for name, rows in added.items()] + [(name, rows, True) for name, rows in (replaced or {}).items()]
        with ThreadPoolExecutor(len(changes)) as pool:  # small jobs, side by side
            paths = list(pool.map(lambda x: x[1] if isinstance(x[1], str) else self._write(x[0], x[1])[0], changes))
        for (name, _, whole), path in zip(changes, paths, strict=True):
            tables[name] = [path] if whole else [*tables.get(name, []), path]
        self.manifest = {"commit": self.manifest["commit"] + 1, "tables": tables}
        write_text(self.spark, f"{self.path}/MANIFEST", json.dumps(self.manifest))

    def recipes(self, *backup_ids: str) -> DataFrame:
        """backup_id, seq, fp of the backups (default: all); with a key, recipes are stored encrypted."""
        rows = self.table("recipes")
        rows = rows.filter(F.col("backup_id").isin(*backup_ids)) if backup_ids else rows
        return rows.withColumn("fp", decrypt(F.unbase64("fp"), self.options.key).cast("string")) if self.options.key else rows

    def _open(self, payload):
        return decrypt(payload, self.options.key) if self.options.key else payload

    def _seal(self, payload):
        return encrypt(payload, self.options.key) if self.options.key else payload

    # ingest

    def ingest(self, backup_id: str, chunks: DataFrame) -> None:
        """Adds a backup: chunks has seq (from 0, without gaps) and chunk (binary)."""
        o, commit, began = self.options, self.manifest["commit"] + 1, time.time()
        rows = keep(chunks.select(F.col("seq").cast("long").alias("seq"), "chunk").withColumn("fp", fingerprint(F.col("chunk"))).withColumn("chunk_size", F.length("chunk").cast("long")), "ingest")
        narrow = rows.select("seq", "fp", "chunk_size")
        fresh = new_chunks(first_occurrences(narrow, ("seq",)), self.table("chunks"))
        fresh = fresh.withColumn("batch", F.floor(F.col("seq") / o.batch))
        payloads = rows.select("seq", "chunk")
        policy = POLICIES[o.policy]
        if policy.mark is None:
            coded = fresh.join(payloads, "seq").withColumns({"base_fp": F.lit(None).cast("string"), "sf": F.lit(None).cast("array<string>"), "deferred": F.lit(False), "encoded": F.lit(None).cast("binary"), "pair": F.lit(None).cast("string")})
        else:
            coded = self._coded(narrow, keep(fresh.join(payloads, "seq").withColumn("sf", super_feature(F.col("chunk"))), "features"))
        is_delta = F.col("base_fp").isNotNull() & (F.length("encoded") < F.col("chunk_size"))
        # One pass: compression is cheap beside a second run of the delta coder over a second branch.
        coded = coded.withColumn("is_delta", is_delta).withColumn("stored", F.when(F.col("is_delta"), F.col("encoded")).otherwise(lz4(F.col("chunk"))))
        stored = keep(coded.drop("chunk", "encoded").withColumn("stored_len", F.length("stored").cast("long")), "stored")
        placed = self._place(stored.withColumn("backup_id", F.lit(backup_id)), "seq")
        out = placed.select(
            "fp", "is_delta", F.when(F.col("is_delta"), F.col("base_fp")).alias("base_fp"), "container_id", "offset", "stored_len", F.col("chunk_size").alias("logical_len"), "sf", "deferred",
            F.lit(commit).alias("commit"), (F.lit(commit).cast("long") * (1 << 40) + F.col("seq")).alias("insert_seq"), self._seal(F.col("stored")).alias("payload"),
        )
        chunks_path, out = self._write("chunks", out)
        bases = out.filter("not is_delta and not deferred and sf is not null")
        name = F.base64(encrypt(F.col("fp").cast("binary"), o.key)) if o.key else F.col("fp")
        added = {"recipes": narrow.select(F.lit(backup_id).alias("backup_id"), "seq", name.alias("fp")), "chunks": chunks_path, "metrics": self._measure(backup_id, commit, narrow, out)}
        if policy.mark:
            added["sf_index"] = feature_index(bases, order="insert_seq").select("slot", "feature", "base_fp", F.col("base_order"))
        if policy.offline:
            added["pending"] = stored.filter("deferred and pair is not null").select(F.col("pair").alias("old_fp"), F.col("fp").alias("new_fp"), (F.lit(commit).cast("long") * (1 << 40) + F.col("batch")).alias("batch_seq"), F.col("seq").alias("pair_seq"))
        added["timings"] = self._timing("ingest", backup_id, began)
        self._commit(added)

    def ingest_in_parts(self, backup_id: str, chunks: DataFrame, batches: int) -> None:
        """Adds a backup by commits of so many batches each, so that its chunks can be bases for later ones of it."""
        size = self.options.batch * batches
        rows = keep(chunks.select(F.col("seq").cast("long").alias("seq"), "chunk"), "parts")
        last = rows.agg(F.max("seq")).first()[0]
        for start in range(0, (last if last is not None else -1) + 1, size):
            self.ingest(backup_id, rows.filter((F.col("seq") >= start) & (F.col("seq") < start + size)))

    def _timing(self, kind: str, backup_id: str | None, began: float) -> DataFrame:
        return self.spark.createDataFrame([(self.manifest["commit"] + 1, kind, backup_id, time.time() - began)], SCHEMAS["timings"])

    def _coded(self, narrow: DataFrame, fresh: DataFrame) -> DataFrame:
        """fresh with base_fp and encoded (where a delta is to be tried), deferred and pair."""
        o = self.options
        asked = may_be_delta(fresh, o.plain_prefix).select("fp", "sf", "chunk_size")
        hits = choose_base(asked, index_owners(self.table("sf_index")), least_bytes=o.least_similar_bytes)
        where = self.table("chunks").select(F.col("fp").alias("base_fp"), F.col("container_id").alias("base_container"))
        hits = hits.join(where, "base_fp").select("fp", "base_fp", "base_container")
        if o.own_bases:
            hits = hits.unionByName(self._own_hits(fresh, hits))
        similar = keep(fresh.select("fp", "batch").join(hits, "fp"), "similar")
        sizes = narrow.groupBy(F.floor(F.col("seq") / o.batch).alias("batch")).agg(F.count("*").alias("n"))
        marked = POLICIES[o.policy].mark(similar, sizes, o).select("fp", F.col("base_fp").alias("pair"), "use", "late")
        out = fresh.join(marked, "fp", "left").withColumn("deferred", F.coalesce("late", F.lit(False))).withColumn("base_fp", F.when(F.col("use"), F.col("pair")))
        wanted = out.filter("base_fp is not null").select("base_fp").distinct()
        plain = self.table("chunks").join(wanted.withColumnRenamed("base_fp", "fp"), "fp", "left_semi").select(F.col("fp").alias("base_fp"), unlz4(self._open(F.col("payload")), F.col("logical_len")).alias("base"))
        if o.own_bases:
            plain = plain.unionByName(fresh.select(F.col("fp").alias("base_fp"), F.col("chunk").alias("base")).join(wanted, "base_fp", "left_semi"))
        with_base = out.filter("base_fp is not null").join(plain, "base_fp").withColumn("encoded", delta(F.col("chunk"), F.col("base"))).drop("base", "use", "late")
        without = out.filter("base_fp is null").withColumn("encoded", F.lit(None).cast("binary")).drop("use", "late")
        return without.unionByName(with_base)

    def _own_hits(self, fresh: DataFrame, hits: DataFrame) -> DataFrame:
        """fp, base_fp, base_container of the chunks that are like one of an earlier batch of the backup.

        A base is the first chunk that has some super-feature in a slot, if no earlier chunk, of the
        store or of the backup, is like it, so that it is sure to become a base. Containers are not known yet; the
        batch of the base stands for its container.
        """
        o = self.options
        rows = fresh.filter(F.col("chunk_size") >= o.least_similar_bytes).join(hits.select("fp"), "fp", "left_anti")
        index = feature_index(rows.withColumn("order", F.struct("batch", "seq")), order="order")
        first = index.groupBy("slot", "feature").agg(F.min(F.struct("base_order", "base_fp")).alias("x")).select("slot", "feature", "x.*")
        placed = index.withColumnsRenamed({"base_fp": "fp", "base_order": "mine"}).join(first, ["slot", "feature"])
        earlier = F.col("base_order.batch") < F.col("mine.batch")
        marked = keep(placed.groupBy("fp").agg(F.max(earlier).alias("like"), F.min(F.when(earlier, F.struct("slot", "base_fp", F.col("base_order.batch").alias("batch")))).alias("hit")), "own")
        roots = marked.filter("not like").select(F.col("fp").alias("base_fp"))
        found = may_be_delta(marked.filter("like"), o.plain_prefix).select("fp", "hit.base_fp", "hit.batch").join(roots, "base_fp", "left_semi")
        return found.select("fp", "base_fp", F.concat(F.lit("own-"), F.col("batch").cast("string")).alias("base_container"))

    def _place(self, stored: DataFrame, order: str) -> DataFrame:
        """Adds container_id and offset; containers of bases and of deltas are numbered on from the last.

        Chunks of ``span`` batches go through one task and have an open container of their own.
        """
        o = self.options
        last = self.table("chunks").select(F.max(F.conv("container_id", 36, 10).cast("long"))).first()[0] or 0
        rows = stored.select("backup_id", "is_delta", order, "fp", "stored_len", F.floor(F.col(order) % (1 << 40) / (o.batch * o.span)).alias("_span"))
        packed = keep(pack_exactly(rows, (order,), streams=("backup_id", "is_delta", "_span"), capacity=o.container_bytes), "packed")
        filled = packed.groupBy("is_delta", "_span").agg((F.max("container") + 1).alias("_n"))  # a row per span
        before = Window.partitionBy(F.lit(0)).orderBy("is_delta", "_span").rowsBetween(Window.unboundedPreceding, -1)
        filled = filled.withColumn("_first", F.lit(last + 1) + F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        named = packed.join(filled, ["is_delta", "_span"]).select("fp", container_name(F.col("container") + F.col("_first")).alias("container_id"), "offset")
        return stored.join(named, "fp")

    def remember(self) -> None:
        """Writes the sketch of all chunks of the recipes, so that a later session reads it (``sketch``) instead of
        counting anew. What commits before the last remembered one added is taken over, not counted again."""
        done = self.table("sketch").agg(F.max("commit")).first()[0] or 0
        last = self.manifest["commit"]
        news = self.table("metrics").filter(F.col("commit") > done).select("backup_id").distinct()
        cells = sketch_counts(self.recipes().join(F.broadcast(news), "backup_id", "left_semi"))
        self._commit({"sketch": cells.select(F.lit(last).alias("commit"), "sketch_row", "position", "cell")})

    def sketch(self) -> DataFrame:
        """The cells as remembered: sketch_row, position, cell."""
        return self.table("sketch").groupBy("sketch_row", "position").agg(F.sum("cell").alias("cell"))

    def _measure(self, backup_id: str, commit: int, narrow: DataFrame, out: DataFrame) -> DataFrame:
        seen = narrow.agg(F.count("*").alias("logical_chunks"), F.coalesce(F.sum("chunk_size"), F.lit(0)).alias("logical_bytes"))
        if_ = lambda c, v: F.coalesce(F.sum(F.when(c, v).otherwise(0)), F.lit(0)).cast("long")
        delta_, length, stored = F.col("is_delta"), F.col("logical_len"), F.col("stored_len")
        kept = out.agg(
            F.count("*").alias("unique_chunks"), if_(~delta_, 1).alias("base_chunks"), if_(delta_, 1).alias("delta_chunks"), if_(F.col("deferred"), 1).alias("deferred_chunks"),
            F.coalesce(F.sum(length), F.lit(0)).alias("unique_bytes"), if_(~delta_, stored).alias("base_bytes"), if_(delta_, stored).alias("delta_bytes"),
            if_(~delta_, length - stored).alias("lz4_saved"), if_(delta_, length - stored).alias("delta_saved"),
        )
        one = seen.crossJoin(kept).withColumn("commit", F.lit(commit)).withColumn("backup_id", F.lit(backup_id))  # one row by one row
        return one.select(*[c.split()[0] for c in SCHEMAS["metrics"].split(", ")])

    # restore

    def chunk_bytes(self, wanted: DataFrame) -> DataFrame:
        """fp and chunk of the fingerprints in wanted; a delta takes its base, one level deep."""
        rows = self.table("chunks").join(wanted.select("fp").distinct(), "fp", "left_semi").select("fp", "is_delta", "base_fp", "logical_len", self._open(F.col("payload")).alias("stored"))
        plain = rows.filter("not is_delta").select("fp", unlz4(F.col("stored"), F.col("logical_len")).alias("chunk"))
        deltas = rows.filter("is_delta")
        bases = self.table("chunks").join(deltas.select(F.col("base_fp").alias("fp")).distinct(), "fp", "left_semi")
        bases = bases.select(F.col("fp").alias("base_fp"), unlz4(self._open(F.col("payload")), F.col("logical_len")).alias("base"))
        return plain.unionByName(deltas.join(bases, "base_fp").select("fp", patch(F.col("stored"), F.col("base")).alias("chunk")))

    def restore(self, *backup_ids: str) -> DataFrame:
        """backup_id, seq, chunk of the backups, to be ordered by seq."""
        recipe = self.recipes(*backup_ids)
        return recipe.join(self.chunk_bytes(recipe), "fp").select("backup_id", "seq", "chunk")

    def orphans(self) -> DataFrame:
        """Recipe entries without a stored chunk: none in a sound store."""
        return self.recipes().join(self.table("chunks").select("fp"), "fp", "left_anti")

    # offline pass

    def optimize(self) -> None:
        """Makes the newest similar chunk the base of the older ones; see the steps below.

        Each deferred pair (old base, new chunk): the new chunk takes over the old one's places in the
        feature index; deltas of the old base are coded against the new one; the old base becomes a delta
        of it. A base is rewritten whole or not at all: if a delta would exceed its chunk, it and its deltas stay.
        From the rank at which ``greedy_alpha`` of the stored bytes is reached, only the index changes. Last, records are moved together and
        small neighbouring containers of bases merge. Depth stays one.
        """
        o, chunks, began = self.options, self.table("chunks"), time.time()
        pairs = latest_bases(self.table("pending"))
        pairs = keep(rank_pairs(pairs) if o.greedy_alpha else pairs.withColumn("rank", F.lit(0)), "pairs")
        small = chunks.select("fp", "is_delta", "base_fp", "stored_len", "logical_len", "sf", "insert_seq")
        bases = small.filter("not is_delta")
        pairs = pairs.join(bases.select(F.col("fp").alias("old_fp"), F.col("stored_len").alias("old_len")), "old_fp").join(bases.select(F.col("fp").alias("new_fp")), "new_fp")
        # C3 and C4: the old base and its deltas, each with the new base.
        moves = pairs.select(F.col("old_fp").alias("fp"), "old_fp", "new_fp", "rank").unionByName(small.filter("is_delta").join(pairs.select("old_fp", "new_fp", "rank"), F.col("base_fp") == F.col("old_fp")).select("fp", "old_fp", "new_fp", "rank"))
        moves = keep(moves, "moves")
        texts = keep(self.chunk_bytes(moves.select("fp").unionByName(moves.select(F.col("new_fp").alias("fp")))), "texts")
        coded = moves.join(texts, "fp").join(texts.select(F.col("fp").alias("new_fp"), F.col("chunk").alias("base")), "new_fp")
        coded = coded.withColumn("encoded", delta(F.col("chunk"), F.col("base"))).select("fp", "old_fp", "new_fp", "rank", "encoded", F.length("encoded").cast("long").alias("size"), F.length("chunk").cast("long").alias("chunk_size"))
        coded = keep(coded.join(small.select("fp", F.col("stored_len").alias("before")), "fp"), "coded")
        fits = F.when(F.col("fp") == F.col("old_fp"), F.col("size") <= F.col("before")).otherwise(F.col("size") <= F.col("chunk_size"))
        whole = coded.groupBy("old_fp", "rank").agg(F.min(fits).alias("fits"), F.sum(F.col("before") - F.col("size")).alias("saved")).filter("fits")
        total = chunks.agg(F.coalesce(F.sum("stored_len"), F.lit(0))).first()[0]
        if o.greedy_alpha:
            whole = greedy_share(whole, total, o.greedy_alpha)
        done = keep(coded.join(whole.select("old_fp"), "old_fp", "left_semi"), "done")
        # C7: rewritten records go to new containers, in order of their place.
        fresh = chunks.drop("payload", "is_delta", "base_fp", "stored_len", "container_id", "offset").join(done.select("fp", F.col("new_fp").alias("base_fp"), "encoded", F.col("size").alias("stored_len")), "fp")
        fresh = fresh.withColumns({"is_delta": F.lit(True), "backup_id": F.lit("pass")})
        fresh = self._place(keep(fresh, "fresh"), "insert_seq").withColumn("payload", self._seal(F.col("encoded")))
        names = chunks.columns
        kept = chunks.join(done.select("fp"), "fp", "left_anti")
        # C5 and C6: records of a container move together; pairs of small containers of bases become one.
        live = kept.groupBy("container_id", "is_delta").agg(F.sum("stored_len").alias("bytes"))
        into = merge_pairs(live.filter("not is_delta"), o.container_bytes)
        into = keep(into.unionByName(live.filter("is_delta").select("container_id", F.col("container_id").alias("merged_into"))), "merged")
        before = Window.partitionBy("merged_into").orderBy("container_id", "offset").rowsBetween(Window.unboundedPreceding, 0)
        places = kept.select("fp", "container_id", "offset", "stored_len").join(into, "container_id")
        places = places.select("fp", F.col("merged_into").alias("container_id"), (F.sum("stored_len").over(before) - F.col("stored_len")).alias("offset"))
        moved = kept.drop("container_id", "offset").join(places, "fp").select(*names)
        result = moved.unionByName(fresh.select(*names))
        # The index: all places of old and of new are cleared, then new's are set.
        digests = small.select("fp", "insert_seq", F.posexplode("sf").alias("slot", "feature"))
        index = swap_owners(self.table("sf_index"), pairs, digests)
        released = pairs.select(F.col("new_fp").alias("fp")).distinct().withColumn("_free", F.lit(True))
        result = result.join(released, "fp", "left").withColumn("deferred", F.col("deferred") & F.col("_free").isNull()).select(*names)
        result_path, result = self._write("chunks", result)
        after = result.agg(F.sum("stored_len")).first()[0] or 0
        row = [(self.manifest["commit"] + 1, pairs.count(), done.filter("fp = old_fp").count(), done.filter("fp <> old_fp").count(), int(total), int(after))]
        log = self.spark.createDataFrame(row, SCHEMAS["passes"])
        self._commit({"passes": log, "timings": self._timing("pass", None, began)}, {"chunks": result_path, "sf_index": index, "pending": self.spark.createDataFrame([], SCHEMAS["pending"])})

    def discard_pending(self) -> None:
        self._commit({}, {"pending": self.spark.createDataFrame([], SCHEMAS["pending"])})

    # reports

    def reduction(self) -> DataFrame:
        """backup_id, commit, logical and stored bytes as ingested, and the ratio of logical bytes so far to what was stored then."""
        so_far = Window.partitionBy(F.lit(0)).orderBy("commit").rowsBetween(Window.unboundedPreceding, 0)
        rows = self.table("metrics").withColumn("stored_bytes", F.col("base_bytes") + F.col("delta_bytes"))
        return rows.select("commit", "backup_id", "logical_bytes", "stored_bytes", (F.sum("logical_bytes").over(so_far) / F.sum("stored_bytes").over(so_far)).alias("reduction"))

    def overhead(self) -> DataFrame:
        """Bytes of the three indexes, and as shares of the logical bytes."""
        logical = self.table("metrics").agg(F.sum("logical_bytes")).first()[0] or 0
        chunks = self.table("chunks")
        fps = chunks.count()
        features = self.table("sf_index").select("slot", "feature").distinct().count()
        keys, edges = chunks.filter("is_delta").agg(F.count_distinct("base_fp"), F.count("*")).first()
        sizes = {"fp": fps * 80, "sf": features * 64, "delta": (keys + edges) * 32}
        return self.spark.createDataFrame([(k, v, 100 * v / logical if logical else None) for k, v in sizes.items()], "kind string, bytes long, percent double")
