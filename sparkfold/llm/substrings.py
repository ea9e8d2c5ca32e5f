"""Removal of repeated strings by prefix-free parsing, distributed.

Parsing: a rolling hash of ``GRAM`` bytes is taken at every byte. The trigger of a ``width``-byte window is
the least hash in it; neighbouring windows with the same trigger form a phrase, which overlaps the next
by width - 1 bytes, so every window lies in exactly one phrase. Equal windows have equal triggers, so the
phrases of a trigger, dealt to buckets by its hash, hold every copy of their windows in the corpus.
Texts go through in bundles. Equal phrases of a bundle are one entry of its dictionary, with the least
and the largest doc_id that has them; the parse, which says where they stand, stays with the bundle.

Ordering: in a bucket, equal phrases of all bundles are put together, and the suffixes of the remaining
dictionary, cut to a window, are put in lexicographic order (``suffix_order``), which brings equal windows
of different phrases together. Documents that hold a window are compared by their least doc_id, so an order of the
parse's suffixes among equal windows is not needed. Bytes decide throughout: prints only propose what is equal.
Each window's least doc_id goes back to the bundles where a larger one has it, and is met with the parse.

Shuffles move compressed blobs: the dictionaries, the answers, and the texts once. A bundle meets at most
``FAN`` buckets at a time; beyond that many, dictionaries are dealt in several levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_code, tidied
from .words import P1, mix, powers

GRAM, SUBS, MOST = 10, 32, 64
NO_ID = np.iinfo(np.int64).max
#: Bytes of text per bucket and per bundle, and of a piece that is parsed at once; buckets at least.
BUCKET_BYTES, BUNDLE_BYTES, PIECE_BYTES, LEAST_BUCKETS = 16 << 20, 16 << 20, 1 << 17, 8
#: Buckets that a blob is dealt to at once.
FAN = 4096
LEVEL = 4
#: Places that bytes are gathered from at once.
GATHERED = 1 << 18
#: Windows whose least doc_ids are met with the parse at once.
WINDOWS_AT_ONCE = 1 << 20
_CODEC: dict[int, pa.Codec] = {}


def _codec() -> pa.Codec:
    return _CODEC.setdefault(LEVEL, pa.Codec("zstd", compression_level=LEVEL))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Columns as one compressed blob."""
    head = np.array([len(arrays), *[x for a in arrays for x in (a.dtype.num, a.nbytes)]], np.int64)
    raw = b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return len(raw).to_bytes(8, "little") + _codec().compress(raw, asbytes=True)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    raw = _codec().decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    out, at = [], 8 + 16 * n
    kinds = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint32, np.int64)}
    for kind, size in head.reshape(-1, 2).tolist():
        kind = kinds[kind]
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(P1, len(data)), out=total[1:])
    return total, powers(pow(P1, -1, 1 << 64), len(data) + 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(values)
    block = np.concatenate([values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """data[starts[i]:starts[i] + lengths[i]], one after the other; about GATHERED places are held at a time."""
    upto = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(int(upto[-1]), data.dtype)
    kind = np.int32 if max(len(data), len(out)) < 1 << 31 else np.int64
    shift = (starts - upto[:-1]).astype(kind)
    edges = np.unique(np.searchsorted(upto, np.append(np.arange(0, len(out), GATHERED), len(out)))).tolist()
    for lo, hi in zip(edges, edges[1:]):
        a, z = int(upto[lo]), int(upto[hi])
        at = np.repeat(shift[lo:hi], lengths[lo:hi])
        at += np.arange(a, z, dtype=kind)
        np.take(data, at, out=out[a:z], mode="clip")  # all are inside; any other mode copies out
    return out


def triggers(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigger of the window at each byte, and the prefix sums that prints are taken from."""
    total, inverse = prefix_sums(data)
    grams = mix((total[GRAM:] - total[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    return sliding_least(grams, width - GRAM + 1), total, inverse


def phrases(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(start, windows, trigger, print) of the phrases of texts that stand one after the other in data up
    to ends. Pieces of bounded size are parsed at a time; a piece, like a long run of one trigger, cuts phrases."""
    parts = []
    for a in range(0, len(data) - width + 1, PIECE_BYTES):
        piece = data[a : a + PIECE_BYTES + width - 1]
        trigger, total, inverse = triggers(piece, width)
        low = int(np.searchsorted(ends, a, side="right"))
        high = int(np.searchsorted(ends, a + len(trigger) - 1, side="right"))
        mine = ends[low : high + 1]
        text_end = np.repeat(mine, np.diff(np.concatenate([[a], np.minimum(mine, a + len(trigger))])))
        at = np.arange(a, a + len(trigger))
        inside = at + width <= text_end
        new = np.ones(len(trigger), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (text_end[1:] != text_end[:-1]) | ~inside[:-1]
        runs = np.flatnonzero(new)
        since = at - a - runs[np.cumsum(new) - 1]
        starts = np.flatnonzero(inside & (since % MOST == 0))
        run_end = np.append(runs[1:], len(trigger))[np.searchsorted(runs, starts, side="right") - 1]
        windows = np.minimum(np.minimum(run_end, text_end[starts] - a - width + 1) - starts, MOST)
        print_ = mix((total[starts + windows + width - 1] - total[starts]) * inverse[starts] + windows.astype(np.uint64))
        parts.append((starts + a, windows, trigger[starts], print_))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none.astype(np.uint64), none.astype(np.uint64))


def distinct(data: np.ndarray, start: np.ndarray, length: np.ndarray, print_: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): of the strings data[start:start + length], the first of each kind, and each one's kind.

    Prints propose what is equal, and the bytes are compared; where they differ, the bytes alone decide.
    """
    _, first, which = np.unique(print_, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[which] != np.arange(len(start)))
    for k in range(0, len(again), step):
        i = again[k : k + step]
        j = first[which[i]]
        if (length[i] != length[j]).any() or (gather(data, start[i], length[i]) != gather(data, start[j], length[j])).any():
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(data[s : s + n].tobytes(), len(number)) for s, n in zip(start.tolist(), length.tolist(), strict=True)], np.int64)
            _, first = np.unique(which, return_index=True)
            break
    return first, which


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; beyond the end stand zeros."""
    one = np.concatenate([data, np.zeros(7, np.uint8)])
    two = one[:-1].astype(np.uint16) << np.uint16(8) | one[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    return four[:-4].astype(np.uint64) << np.uint64(32) | four[4:]


def suffix_order(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows data[at:at + width] in lexicographic order, and which of them differ from the one before.

    The order is refined among those that are equal so far, by as many bytes at a time as go beside
    the number of the group of equals in 64 bits.
    """
    words = big_endian_words(data)
    done = min(8, width)
    key = words[at] >> np.uint64(64 - 8 * done)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    while done < width:
        same = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(same):
            break
        which, group = order[same], np.cumsum(new[same]).astype(np.uint64)
        more = min(8 - (int(group[-1]).bit_length() + 7) // 8, width - done)
        key = group << np.uint64(8 * more) | words[at[which] + done] >> np.uint64(64 - 8 * more)
        by = np.argsort(key)
        order[same], key = which[by], key[by]
        new[same[1:]] |= key[1:] != key[:-1]
        done += more
    return order, new


def fans(buckets: int, fan: int) -> list[int]:
    """Numbers of buckets after each level of dealing; each is a multiple of the one before, by fan at most."""
    levels = 1
    while fan**levels < buckets:
        levels += 1
    top = -(-buckets // fan ** (levels - 1))
    return [top * fan**i for i in range(levels)]


def _deal(trigger: np.ndarray, buckets: int, columns: tuple, length: np.ndarray, data: np.ndarray, start: np.ndarray):
    """(bucket, blob) for each bucket of the triggers: how many entries each of its parts has, the columns,
    the phrases' windows included, and their bytes."""
    place = trigger >> np.uint64(8)
    bucket = (place % np.uint64(buckets)).astype(np.int64)
    sub = ((place // np.uint64(buckets)) % np.uint64(SUBS)).astype(np.int64)
    order = np.lexsort((trigger, sub, bucket))
    bucket, sub, length, start = bucket[order], sub[order], length[order], start[order]
    columns = tuple(c[order] for c in columns)
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []
    for lo, hi in zip(edges, [*edges[1:], len(bucket)], strict=True):
        subs = np.bincount(sub[lo:hi], minlength=SUBS).astype(np.uint32)
        yield int(bucket[lo]), pack_arrays(subs, *[c[lo:hi] for c in columns], gather(data, start[lo:hi], length[lo:hi]))


def dictionary(ids: np.ndarray, ends: np.ndarray, data: np.ndarray, buckets: int, width: int):
    """(bucket, blob) rows of a bundle: entries' numbers, windows, least doc_id, largest less least, bytes."""
    start, windows, trigger, print_ = phrases(data, ends, width)
    if not len(start):
        return
    first, which = distinct(data, start, windows + width - 1, print_)
    by = np.argsort(which, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(which))[:-1]])
    owner = ids[np.searchsorted(ends, start, side="right")][by]
    least, most = np.minimum.reduceat(owner, at), np.maximum.reduceat(owner, at)
    columns = (np.arange(len(first), dtype=np.uint32), windows[first].astype(np.uint8), least, most - least)
    yield from _deal(trigger[first], buckets, columns, windows[first] + width - 1, data, start[first])


def deal_again(blob: bytes, buckets: int, width: int):
    """A blob of ``_deal`` for a finer number of buckets."""
    _, numbers, windows, least, more, data = unpack_arrays(blob)
    length = windows.astype(np.int64) + width - 1
    start = np.cumsum(length) - length
    yield from _deal(triggers(data, width)[0][start], buckets, (numbers, windows, least, more), length, data, start)


def answers(blobs: list[bytes], width: int) -> Iterator[tuple[int, list[tuple]]]:
    """(number of the blob, [numbers, windows, least doc_ids of the windows]) for the entries that have a
    larger doc_id than one of their windows' least."""
    opened = []
    for blob in blobs:
        subs, numbers, windows, *rest = unpack_arrays(blob)
        edges = np.concatenate([[0], np.cumsum(subs, dtype=np.int64)])
        upto = np.concatenate([[0], np.cumsum(windows.astype(np.int64) + width - 1)])[edges]
        opened.append((edges.tolist(), upto.tolist(), numbers, windows, *rest))
    for sub in range(SUBS):
        parts, whose = [], []
        for k, (edges, upto, numbers, windows, least, more, data) in enumerate(opened):
            lo, hi = edges[sub], edges[sub + 1]
            if lo < hi:
                parts.append((numbers[lo:hi], windows[lo:hi].astype(np.int64), least[lo:hi], least[lo:hi] + more[lo:hi], data[upto[sub] : upto[sub + 1]]))
                whose.append(np.full(hi - lo, k))
        if not parts:
            continue
        numbers, windows, least, most, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        picked, first_id, upto = _least_ids(windows, least, most, data, width)
        who = np.concatenate(whose)[picked]
        for k in np.unique(who).tolist():
            mine = picked[who == k]
            yield k, (numbers[mine], windows[mine].astype(np.uint8), gather(first_id, upto[mine], windows[mine]))


def _least_ids(windows: np.ndarray, least: np.ndarray, most: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries to answer, least doc_id per window of the distinct phrases, where an entry's begin there)."""
    length = windows + width - 1
    start = np.cumsum(length) - length
    total, inverse = prefix_sums(data)
    first, which = distinct(data, start, length, mix((total[start + length] - total[start]) * inverse[start]))
    by = np.argsort(which, kind="stable")
    least = np.minimum.reduceat(least[by], np.concatenate([[0], np.cumsum(np.bincount(which))[:-1]]))
    wins = windows[first]
    upto = np.cumsum(wins) - wins
    phrase = np.repeat(np.arange(len(first)), wins)
    at = np.arange(len(phrase)) + (start[first] - upto)[phrase]
    order, new = suffix_order(data, at, width)
    group = np.flatnonzero(new)
    first_id = np.empty(len(order), np.int64)
    first_id[order] = np.repeat(np.minimum.reduceat(least[phrase][order], group), np.diff(np.append(group, len(order))))
    lowest = np.minimum.reduceat(first_id, upto)
    return np.flatnonzero(lowest[which] < most), first_id, upto[which]


def removed(ids: np.ndarray, ends: np.ndarray, data: np.ndarray, found: list[list[np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) in data of the maximal runs that a bundle loses; found are the answers it got."""
    none = np.zeros(0, np.int64)
    if not found:
        return none, none, none
    start, windows, _, print_ = phrases(data, ends, width)
    first, which = distinct(data, start, windows + width - 1, print_)
    numbers, counts, least = (np.concatenate(x) for x in zip(*found, strict=True))
    counts = counts.astype(np.int64)
    begin = np.full(len(first), -1, np.int64)
    begin[numbers] = np.cumsum(counts) - counts
    some = np.flatnonzero(begin[which] >= 0)
    parts, upto = [(none, none, none)], np.cumsum(windows[some])
    edges = np.searchsorted(upto, np.arange(0, upto[-1] if len(some) else 0, WINDOWS_AT_ONCE)).tolist()
    for a, z in zip(edges, [*edges[1:], len(some)], strict=True):
        part = some[a:z]
        parts.append(_gone(start[part], windows[part], gather(least, begin[which[part]], windows[part]), ids, ends, width))
    text, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(text):
        return none, none, none
    reach = np.maximum.accumulate(end)
    fresh = np.append(True, (start[1:] > reach[:-1]) | (text[1:] != text[:-1]))
    return text[fresh], start[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(text) - 1)]


def _gone(start: np.ndarray, windows: np.ndarray, least: np.ndarray, ids: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the runs of windows, of phrases at start, that a smaller doc_id has too."""
    text = np.searchsorted(ends, start, side="right")
    row = np.repeat(np.arange(len(start)), windows)
    gone = least < ids[text][row]
    at = np.arange(len(row)) + (start - (np.cumsum(windows) - windows))[row]
    cut = np.append(True, row[1:] != row[:-1])
    lo = np.flatnonzero(gone & (cut | np.append(True, ~gone[:-1])))
    hi = np.flatnonzero(gone & np.append(cut[1:] | ~gone[1:], True))
    return text[row[lo]], at[lo], at[hi] + width


def _cleaned(ids: np.ndarray, null: np.ndarray, ends: np.ndarray, data: np.ndarray, spans: tuple) -> pa.Table:
    text, start, end = spans
    begin = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    kept = np.cumsum(edge[:-1], dtype=np.int8) == 0
    upto = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
    blobs = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(upto.astype(np.int64).tobytes()), pa.py_buffer(data[kept].tobytes())])
    at = np.searchsorted(text, np.arange(len(ids) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x - begin[text])) for x in (start, end)]
    return pa.table([pa.array(ids, mask=null.astype(bool)), pa.array(ends - begin), blobs.cast(pa.binary()), *lists], names=["doc_id", "n_bytes", "kept", "starts", "ends"])


def _rereadable(docs: DataFrame) -> bool:
    """Whether docs are files and nothing but projections and filters, so that rows come in the same order again
    when a lost bundle is read anew; others are written first."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    nodes = {line.lstrip(" +-:").split(" ")[0] for line in plan.toString().splitlines()}
    return plan.deterministic() and nodes <= {"Project", "Filter", "Relation"}


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def _bundles(docs: DataFrame) -> DataFrame:
    """bundle, blob: doc_ids (null: the largest), which are null, ends of the texts, and the texts."""

    def run(batches):
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in tidied(batches):
            at, ends = 0, _offsets(batch.column(1)) if batch.num_rows else np.zeros(1, np.int64)
            while at < batch.num_rows:
                upto = min(int(np.searchsorted(ends, ends[at] + BUNDLE_BYTES - size)), batch.num_rows)
                upto = max(upto, at + 1)
                parts.append(batch.slice(at, upto - at))
                size += int(ends[upto] - ends[at])
                at = upto
                if size >= BUNDLE_BYTES:
                    yield _bundle(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield _bundle(number, parts)

    return docs.mapInArrow(run, "bundle long, blob binary")


def _bundle(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    ids, texts = (pa.concat_arrays([p.column(i) for p in parts]) for i in (0, 1))
    ends = _offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    blob = pack_arrays(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), null, ends[1:] - ends[0], data)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary())], ["bundle", "blob"])


def remove_repeats(docs: DataFrame, text: str = "text", width: int = 50, fan: int = FAN) -> DataFrame:
    """Texts without the strings of ``width`` bytes that also start in a document of smaller doc_id.

    Returns per row of docs: doc_id, n_bytes, kept (the remaining UTF-8 bytes), starts and ends (maximal removed
    runs, in bytes). Strings are judged on the input. A null text counts as empty; texts shorter than
    width are kept whole, and long ones parsed whole, a piece at a time. A null doc_id counts as larger
    than any. Rows of one doc_id, or of none, clean nothing from each other, and repeated rows are
    cleaned alike. An empty table gives no rows; other columns are ignored.
    """
    ship_code(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    docs = docs if _rereadable(docs) else materialize(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bundles = _bundles(docs).repartition("bundle")  # one shuffle, which the parse and the last step both read
    *levels, buckets = fans(max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)), fan)
    entry = "bucket long, bundle long, blob binary"
    first = levels[0] if levels else buckets

    def parse(batches):
        for batch in tidied(batches):
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, _, ends, data = unpack_arrays(blob.as_py())
                yield from _rows(((b, number, x) for b, x in dictionary(ids, ends, data, first, width)), entry)

    entries = bundles.mapInArrow(parse, entry)
    for finer in [*levels[1:], buckets] if levels else ():

        def split(batches, finer=finer):
            for batch in tidied(batches):
                for number, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    yield from _rows(((b, number, x) for b, x in deal_again(blob, finer, width)), entry)

        entries = materialize(entries.repartition("bucket", F.pmod(F.hash("bundle"), F.lit(16))).mapInArrow(split, entry))

    def order(table: pa.Table) -> pa.Table:
        whose = table.column("bundle").to_pylist()
        held: dict[int, list] = {}
        for k, answer in answers(table.column("blob").to_pylist(), width):
            held.setdefault(whose[k], []).append(answer)
        out = [(n, pack_arrays(*(np.concatenate(x) for x in zip(*parts, strict=True)))) for n, parts in held.items()]
        return pa.table([pa.array([n for n, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["bundle", "blob"])

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [unpack_arrays(b) for b in right.column("blob").to_pylist()]
        out = []
        for blob in left.column("blob").to_pylist():
            ids, null, ends, data = unpack_arrays(blob)
            out.append(_cleaned(ids, null, ends, data, removed(ids, ends, data, found, width)))
        return pa.concat_tables(out)

    replies = entries.groupBy("bucket").applyInArrow(order, "bundle long, blob binary")
    return bundles.groupBy("bundle").cogroup(replies.groupBy("bundle")).applyInArrow(clean, "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")


def _rows(found, schema: str, limit: int = 8 << 20):
    """Record batches of (bucket, bundle, blob) of about limit bytes."""
    held, size = [], 0
    for row in found:
        held.append(row)
        size += len(row[2])
        if size >= limit:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "bundle", "blob"])
