"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

Signature: a text is the weighted set of its five-word shingles, a shingle's weight being its count.
Each unit of an element's weight is a region at which hashed darts are thrown, in order of their
rank (a Poisson process, the same in every text that holds the unit). A dart falls on a random
coordinate of the signature; the earliest dart on a coordinate is kept, so two texts agree on a
coordinate with the probability of their weighted Jaccard similarity. About k ln k + 2k darts per
text fill the signature, however many elements it has; texts with a gap get twice the darts.

Joining: texts with the same word sequence are first put together under their smallest doc_id.
Signatures are cut into bands; a bucket is a band's value. Two texts are linked if the weighted, or the
plain, Jaccard similarity of their shingles is 0.8 or more; a text that repeats shingles has bands of
its distinct ones as well, so both kinds of similarity meet in a bucket. Links are found in two steps:

1. Hubs merge the large groups of copies at little cost: in each of ``HUB_ROUNDS`` rounds a bucket picks
   hubs among its members, and members of another class than a hub's are compared with it.
2. The members of all buckets that still have several classes go through an exact set similarity
   join (``unseen_pairs``), so that no pair that shares a bucket is left out. The number of rounds
   thus decides on the cost alone.

A bucket is never paired with itself, joins on hot buckets and hubs are plain sort-merge joins whose
large partitions Spark splits, and links and classes stay on the executors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_code, tidied
from .words import mix, sequence_hashes, shingles, slices, word_hashes

BANDS, ROWS, WIDTH, SIMILARITY = 24, 5, 5, 0.8
#: Rounds of hubs before the exact join; the first has one hub a bucket, the others three.
HUB_ROUNDS = 2
#: Ids, or pairs of ids, that may be broadcast to their texts or shingle sets.
FEW_IDS = 100_000
#: Tokens in a batch from Python workers.
TOKENS_AT_ONCE = 500_000


def dart_minhash(owner: np.ndarray, units: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """Signatures (n_texts, k) of 32-bit dart names; owner and units give each text's weight units."""
    out = np.full((n_texts, k), np.iinfo(np.uint64).max, np.uint64)
    weight = np.bincount(owner, minlength=n_texts)
    reach = (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = np.arange(len(owner))
    flat = out.reshape(-1)
    while len(todo):
        who, state = owner[todo], units[todo]
        limit, rank = reach[who], np.zeros(len(todo))
        base = who.astype(np.int64) * k
        while len(state):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            rank = rank - np.log(((state >> np.uint64(11)) + np.uint64(1)) * 2.0**-53)
            live = rank <= limit
            if not live.all():
                state, rank, limit, base = state[live], rank[live], limit[live], base[live]
            name = mix(state ^ np.uint64(0xD1B54A32D192ED03))
            dart = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))
            np.minimum.at(flat, base + ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64), dart)
        gaps = (out == np.iinfo(np.uint64).max).any(axis=1) & (weight > 0)
        reach[gaps] *= 2
        todo = np.flatnonzero(gaps[owner])
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_values(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
    for r in range(rows):
        total = mix((total + parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return total.view(np.int64)


def _units(hashes: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """A name for each unit of a shingle's count: weighted Jaccard is plain Jaccard of these."""
    return mix(hashes + occurrence.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def signatures(docs: DataFrame, text: str, bands: int, rows: int) -> DataFrame:
    """id, h1, h2 (hashes of the word sequence), n and u (distinct shingles, and all), bands (null for a
    text without words): those of the weighted shingles, and where n < u those of the distinct ones too."""
    ship_code(docs.sparkSession)

    def run(batches):
        for batch in tidied(batches):
            ids = batch.column(0)
            for first, texts in slices(batch.column(1).to_pylist()):
                words, upto = word_hashes(texts)
                h1, h2 = sequence_hashes(words, upto)
                owner, hashes, occurrence = shingles(words, upto, WIDTH)
                units = _units(hashes, occurrence)
                values = band_values(dart_minhash(owner, units, len(texts), bands * rows), bands, rows)
                n, u = (np.bincount(o, minlength=len(texts)).astype(np.int32) for o in (owner[occurrence == 0], owner))
                twice = np.flatnonzero(n < u)
                which = np.full(len(texts), -1)
                which[twice] = np.arange(len(twice))
                plain = (occurrence == 0) & (which[owner] >= 0)
                more = band_values(dart_minhash(which[owner[plain]], units[plain], len(twice), bands * rows), bands, rows)
                at = np.concatenate([np.repeat(np.arange(len(texts)), bands), np.repeat(twice, bands)])
                flat = np.concatenate([values.ravel(), more.ravel()])[np.argsort(at, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(bands * (1 + (n < u)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(flat), mask=pa.array(np.diff(upto) == 0))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(h1), pa.array(h2), pa.array(n), pa.array(u), lists], ["id", "h1", "h2", "n", "u", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "id long, h1 long, h2 long, n int, u int, bands array<long>")


def unit_sets(docs: DataFrame, text: str) -> DataFrame:
    """id, size (distinct shingles), units (sorted 32-bit names: first of the distinct, then of the rest)."""
    ship_code(docs.sparkSession)

    def run(batches):
        for batch in tidied(batches):
            ids = batch.column(0)
            for first, texts in slices(batch.column(1).to_pylist()):
                words, upto = word_hashes(texts)
                owner, hashes, occurrence = shingles(words, upto, WIDTH)
                names = (_units(hashes, occurrence) >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((names, occurrence > 0, owner))
                names, owner, more = names[order], owner[order], occurrence[order] > 0
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                sizes = np.bincount(owner[~more], minlength=len(texts))
                blobs = pa.array([names[ends[i] : ends[i + 1]].tobytes() for i in range(len(texts))], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(sizes.astype(np.int32)), blobs], ["id", "size", "units"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "id long, size int, units binary")


def similar(a: bytes, n: int, b: bytes, m: int, least: float) -> bool:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return False
    shared = len(np.intersect1d(x[:n], y[:m], assume_unique=False))
    if shared >= least * (n + m - shared):
        return True
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    shared += len(np.intersect1d(x[n:], y[m:], assume_unique=False))
    return shared >= least * (len(x) + len(y) - shared)


def verify(pairs: DataFrame, sets: DataFrame, least: float, tasks: int) -> DataFrame:
    """The pairs (a, hub) whose shingle sets are similar enough, compared in at most ``tasks`` tasks."""
    mine, hubs = (sets.withColumnsRenamed({"id": i, "size": n, "units": u}) for i, n, u in (("a", "n", "x"), ("hub", "m", "y")))
    if pairs.limit(FEW_IDS + 1).count() <= FEW_IDS:  # a bounded number of pairs goes to the sets, more meet them in a shuffle
        hubs = hubs.join(F.broadcast(pairs.select("hub").distinct()), "hub", "left_semi")
        both = mine.join(F.broadcast(pairs), "a").join(hubs, "hub")
    else:
        both = pairs.join(mine, "a").join(hubs, "hub")

    def run(batches):
        for batch in batches:
            a, hub, n, x, m, y = (c.to_pylist() for c in batch.columns)
            kept = [i for i in range(len(a)) if similar(x[i], n[i], y[i], m[i], least)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([hub[i] for i in kept], pa.int64())], ["a", "hub"])

    return both.select("a", "hub", "n", "x", "m", "y").coalesce(tasks).mapInArrow(run, "a long, hub long")


def _tokens(sets: DataFrame) -> DataFrame:
    """id, token per member of the sets; tokens of 1 << 32 and above are of repeated shingles."""

    def run(batches):
        names, owners, size = [], [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), pa.array(np.concatenate(names))], ["id", "token"])
        for batch in tidied(batches):
            for i, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(blob, np.uint32).astype(np.int64)
                names.append(np.concatenate([np.unique(x[:n]), np.unique(x[n:]) | (1 << 32)]))
                owners.append(np.full(len(names[-1]), i, np.int64))
                size += len(names[-1])
                if size >= TOKENS_AT_ONCE:
                    yield done()
                    names, owners, size = [], [], 0
        if size:
            yield done()

    return sets.select("id", "size", "units").mapInArrow(run, "id long, token long")


def unseen_pairs(reps: DataFrame, sets: DataFrame, least: float, tasks: int) -> DataFrame:
    """Pairs (a, hub) of reps (rep, n, u, label) of different labels, among them all that are similar enough.

    A set similarity join without loss: tokens are in order of the number of texts that have them, rarest
    first. Two texts x and y, x no larger, that are similar enough share ceil(2t / (1 + t) * |x|) tokens of x
    at least, so one of x's first |x| less that many plus one is among y's first |y| - ceil(t * |y|) + 1 (prefix
    filter with the shorter prefix on the smaller text), and where two prefixes meet, enough tokens are left
    on both sides (positional filter, a part of the join's condition). Tokens of one text alone can't
    be shared, so they use up the prefix and make no rows; texts that differ by more than the prefix
    have none. Kind 0 joins distinct shingles, kind 1 all of them.
    """
    few = F.broadcast(reps.select(F.col("rep").alias("id"))) if reps.count() <= FEW_IDS else reps.select(F.col("rep").alias("id"))
    rows = _tokens(sets.join(few, "id", "left_semi"))
    seen = rows.groupBy("token").agg(F.count("*").alias("texts")).filter("texts > 1")
    ordered = rows.join(seen, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("texts", "token"))).alias("every"))
    ordered = ordered.withColumn("once", F.filter("every", lambda x: x["token"] < F.lit(1 << 32)))
    ordered = ordered.join(reps, F.col("id") == F.col("rep")).select("rep", "label", F.array(*[F.struct(F.lit(k).alias("kind"), F.col(size).alias("size"), F.col(c).alias("tokens")) for k, size, c in ((0, "n", "once"), (1, "u", "every"))]).alias("kinds"))
    ordered = ordered.select("rep", "label", F.explode("kinds").alias("x")).select("rep", "label", "x.*").withColumn("length", F.size("tokens"))
    share = lambda part: F.ceil(F.col("size") * F.lit(part) - 1e-6).cast("int")
    ordered = ordered.withColumns({"need": share(least), "most": share(2 * least / (1 + least))}).filter("length >= need")
    heads = ordered.select("rep", "label", "kind", "size", "length", "most", F.posexplode(F.slice("tokens", F.lit(1), F.col("length") - F.col("need") + 1)).alias("at", "x"))
    heads = materialize(heads.select("kind", F.col("x.token").alias("token"), "label", "rep", "size", (F.col("length") - F.col("at")).alias("left"), (F.col("at") <= F.col("length") - F.col("most")).alias("short")), tasks)
    x = heads.filter("short").select("kind", "token", F.col("rep").alias("a"), F.col("label").alias("a_label"), F.col("size").alias("a_size"), F.col("left").alias("a_left"))
    y = heads.select("kind", "token", F.col("rep").alias("hub"), "label", "size", "left")
    smaller = (F.col("a_size") < F.col("size")) | (F.col("a_size") == F.col("size")) & (F.col("a") < F.col("hub"))
    enough = F.least("a_left", "left") >= (F.col("a_size") + F.col("size")) * F.lit(least / (1 + least)) - 1e-6
    return x.join(y, (x["kind"] == y["kind"]) & (x["token"] == y["token"]) & (F.col("a_label") != F.col("label")) & smaller & enough).select("a", "hub").distinct()


def components(edges: DataFrame, tasks: int | None = None, bound: int = 10_000) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): label is the least node of the connected component.

    Up to ``bound`` edges are merged in one task. More are merged in rounds, in which labels spread to
    neighbours and jump along labels, so their number grows with the logarithm of a component's
    width; each round is written to the shared scratch folder. Both ways give the same labels.
    """
    edges = materialize(edges.select("a", "b").distinct(), tasks)
    if edges.count() <= bound:
        return materialize(edges.coalesce(1).mapInArrow(_union, "node long, label long"))
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), tasks)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), tasks)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        step = materialize(spread.join(jump, F.col("new") == F.col("_n"), "left").select("node", "label", F.least("new", F.coalesce("_l", "new")).alias("new")), tasks)
        changed = step.filter("new < label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _union(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], ["node", "label"])


def merged(state: DataFrame | None, found: DataFrame, tasks: int) -> DataFrame:
    """state (node, label, links, was) with the links found (a, hub), and the classes they join merged."""
    edges = found.select("a", F.col("hub").alias("b"))
    if state is not None:  # between classes so far
        for end in ("a", "b"):
            edges = edges.join(state.select("node", "label"), F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("label", end)).drop("node", "label")
    moved = components(edges.filter("a <> b"), tasks)
    news = found.select(F.col("a").alias("node"), F.lit(1).alias("links"), F.lit(False).alias("was")).unionByName(found.select(F.col("hub").alias("node"), F.lit(1).alias("links"), F.lit(True).alias("was")))
    news = news.withColumn("label", F.col("node"))
    if state is not None:
        news = news.unionByName(state)
    news = news.groupBy("node").agg(F.min("label").alias("label"), F.sum("links").cast("int").alias("links"), F.max("was").alias("was"))
    moved = moved.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return materialize(news.join(moved, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"), "links", "was"), tasks)


def _links(members: DataFrame, state: DataFrame | None) -> DataFrame:
    """members (rep, n, u, bucket) with the label of a rep's class, its links, and whether it was a hub."""
    if state is None:
        return members.withColumns({"label": F.col("rep"), "links": F.lit(0), "was": F.lit(False)})
    known = members.join(state, F.col("rep") == F.col("node"), "left")
    return known.select("rep", "n", "u", "bucket", F.coalesce("label", "rep").alias("label"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("was", F.lit(False)).alias("was"))


def _mixed(linked: DataFrame) -> DataFrame:
    """The buckets whose members are of several classes."""
    return linked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")


def _hub_pairs(linked: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs (a, hub) of a bucket's members and its hubs, of different classes and of sizes that allow a link.

    One hub by hash, alike in all buckets; after the first round also one by the bucket's own hash, and
    the member of most links that was no hub yet.
    """
    named = [F.col("rep").alias("hub"), F.col("label").alias("hub_label"), F.col("n").alias("hub_n"), F.col("u").alias("hub_u")]
    kinds = {"drawn": F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), *named))}
    if turn:
        kinds["own"] = F.min(F.struct(F.xxhash64("rep", "bucket", F.lit(-turn)).alias("h"), *named))
        kinds["middle"] = F.min(F.struct(F.col("was"), -F.col("links"), F.xxhash64("rep", "bucket", F.lit(turn)).alias("h"), *named))
    picked = linked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), *[v.alias(k) for k, v in kinds.items()]).filter("low < high")
    hub = lambda c: F.struct(*[F.col(f"{c}.{x}") for x in ("hub", "hub_label", "hub_n", "hub_u")])
    picked = picked.select("bucket", F.explode(F.array(*map(hub, kinds))).alias("x")).select("bucket", "x.*")
    pairs = linked.select("rep", "n", "u", "bucket", "label").join(picked, "bucket").filter("label <> hub_label")
    near = lambda x, y: F.least(x, y) >= F.greatest(x, y) * F.lit(least)
    return pairs.filter(near("n", "hub_n") | near("u", "hub_u")).select(F.col("rep").alias("a"), "hub").distinct()


def near_duplicate_classes(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, least: float = SIMILARITY, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class, per row of docs (doc_id, text).

    Words are as in ``words``; a null or empty text, or one without words, is alone in its class. A text
    of one to four words has one shingle of all of them; texts of any length are taken whole. A null
    doc_id joins the class of an equal text that has an id, else its class_id is null. Repeated rows are
    returned each; an empty table gives no rows; further columns are ignored. Any number of
    ``hub_rounds`` gives the same classes.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    signed = materialize(signatures(docs, "text", bands, rows))
    filled = signed.filter("bands is not null")
    reps = filled.filter("id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("u").alias("u"), F.min("bands").alias("bands"))
    reps = materialize(reps)
    values = reps.select("rep", "n", "u", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = values.groupBy("bucket").count().filter("count > 1").select("bucket")
    members = materialize(values.join(shared, "bucket"))
    few = max(24, members.count() // 100_000)  # tasks for narrow rows
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    # A bounded number of ids picks their texts before the shuffle; more are joined.
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_IDS else wanted
    sets = unit_sets(docs.join(wanted, "doc_id", "left_semi"), "text")
    sets = materialize(sets.dropDuplicates(["id"]))

    # Of the reps with a link: label of their class, links, and whether they were a hub.
    state = tested = None

    def test(pairs: DataFrame) -> None:
        nonlocal state, tested
        if tested is not None:
            pairs = pairs.join(tested, ["a", "hub"], "left_anti")
        pairs = materialize(pairs, few)
        found = materialize(verify(pairs, sets, least, max(24, pairs.count() // 1000)))
        both_ways = pairs.unionByName(pairs.select(F.col("hub").alias("a"), F.col("a").alias("hub")))
        tested = both_ways if tested is None else tested.unionByName(both_ways)
        if found.limit(1).count():
            state = merged(state, found, few)

    for turn in range(hub_rounds):
        linked = _links(members, state)
        if turn:  # buckets of one class are done for good
            linked = materialize(linked.join(_mixed(linked), "bucket", "left_semi"), few)
            members = linked.select("rep", "n", "u", "bucket")
        test(_hub_pairs(linked, turn, least))
    # What the hubs left: reps of buckets that still have several classes, all compared.
    rest = _links(members, state)
    rest = materialize(rest.join(_mixed(rest), "bucket", "left_semi").select("rep", "n", "u", "label").distinct(), few)
    if rest.limit(1).count():
        test(unseen_pairs(rest, sets, least, few))

    classes = reps.select("h1", "h2", "rep")
    if state is not None:
        classes = classes.join(state.select("node", "label"), F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("label", "rep").alias("rep"))
    known = filled.select("id", "h1", "h2").join(classes, ["h1", "h2"], "left").select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"))
    return known.unionByName(signed.filter("bands is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id")))
