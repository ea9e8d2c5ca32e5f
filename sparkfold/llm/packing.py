"""Packing token sequences into fixed windows by Karmarkar-Karp multiway differencing.

Each task reads whole documents, so no rows move between tasks. Of a document of more tokens than a
window, whole windows are cut off; remainders are never cut. A partition's remainders go through in
blocks of about ``block_windows`` windows, and those of a block are shared among its windows by the differencing
method: the two partial partitions with the largest spread are merged again and again, the largest
sums of one on the smallest of the other, which leaves windows of nearly equal length. Where the fullest is still
above capacity, single items move or change places with a window of room; where that is not enough,
the window count rises and the block is partitioned anew.

A block is filled to 1 - 1/SLACK of its windows' capacity, because differencing leaves the fullest some 35 of
4096 tokens above the mean. On the documents at hand about 1 % of all tokens are padding, and up
to one window at the end of a partition; round robin instead of differencing would pad more than a third.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, ChunkCoder, ship_code, tidied

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_CODERS: dict[str, ChunkCoder] = {}
CACHES.append(_CODERS)


#: A block leaves one token in SLACK of its capacity free; windows that an exchange looks at for room.
SLACK, LOWEST = 100, 64
#: ASCII punctuation without the apostrophe, which can begin a pre-token of its own kind.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokenizer:
    """Token ids of chunks, by way of a bounded memo of words and punctuation runs.

    A chunk is cut before its last ASCII punctuation run: where a letter or digit stands before it,
    a pre-token ends there. New letter runs are tokenized joined by spaces in one call and told apart
    by the suffix that marks the last token of a pre-token; other words go through one by one.
    """

    def __init__(self, path: str, memo_limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.tail = TAIL if suffix else ""
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {t[-1] for t in added} & set(TAIL)  # a run with these may be the end of an added token
        self.folds = self._ids(["A", "\u00c4"]) == self._ids(["a", "\u00e4"]) and not any(t.isalpha() for t in added)
        self.heads = {t[:2] for t in added}
        self.memo_limit = memo_limit
        self.words: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {"": b""}

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def prepare(self, texts: pa.Array) -> pa.Array:
        """Lower-cases ASCII first where the tokenizer does so anyway and no added token may occur."""
        if self.folds and not any(pc.any(pc.match_substring(texts, h)).as_py() for h in self.heads):
            return pc.ascii_lower(texts)
        return texts

    def __call__(self, chunks: list[str]) -> list[bytes]:
        words, rest, tail = self.words, self.rest, self.tail
        if len(words) > self.memo_limit:
            words.clear()
        if len(rest) > self.memo_limit:
            rest.clear()
            rest[""] = b""
        bare = [c.rstrip(tail) for c in chunks]
        ends = [c[len(w) :] for c, w in zip(chunks, bare, strict=True)]
        new_rest = set(ends).difference(rest)
        unsafe = {t for t in set(ends) if t and not self.marks.isdisjoint(t)}
        for i, w in enumerate(bare):
            if ends[i] and (not w[-1:].isalnum() or ends[i] in unsafe):
                bare[i], ends[i] = chunks[i], ""
        new = set(bare).difference(words)
        runs = [w for w in new if w.isalpha()] if tail else []
        self._learn_runs(runs)
        other = list(new.difference(runs))
        words.update(zip(other, self._ids(other), strict=True))
        new_rest = list(new_rest)
        rest.update(zip(new_rest, self._ids(new_rest), strict=True))
        return [words[w] + rest[t] if t else words[w] for w, t in zip(bare, ends, strict=True)]

    def _learn_runs(self, new: list[str]) -> None:
        if not new:
            return
        ids = self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(new):
            flat, stops = np.array(ids, "<u4").tobytes(), (4 * ends).tolist()
            self.words.update((w, flat[a:b]) for w, a, b in zip(new, [0, *stops[:-1]], stops, strict=True))
        else:  # some letter run is no single pre-token here
            self.words.update(zip(new, self._ids(new), strict=True))


def tokenizer_coder(path: str) -> ChunkCoder:
    """A coder for a tokenizer file whose pre-tokens never cross ASCII white space and drop it."""
    if path not in _CODERS:
        words = WordTokenizer(path)
        _CODERS[path] = ChunkCoder(words, words.prepare, slice_bytes=4 << 20)
    return _CODERS[path]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp for k windows: lists of item numbers, of nearly equal sums.

    A partial partition is its k sums in descending order and the tree of items behind each sum.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = s, i
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        nodes = np.where(x < 0, y, x)
        both = (x >= 0) & (y >= 0)
        pairs = x[both].tolist()
        nodes[both] = np.arange(len(left), len(left) + len(pairs))
        left += pairs
        right += y[both].tolist()
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), turn, sums, nodes))
        turn += 1
    windows = []
    for node in heap[0][3] if heap else ():
        items, todo = [], [int(node)] if node >= 0 else []
        while todo:
            n = todo.pop()
            if left[n] < 0:
                items.append(n)
            else:
                todo += [right[n], left[n]]
        windows.append(items)
    return windows


def exchange(windows: list[list[int]], sizes: list[int], capacity: int, steps: int) -> list[int]:
    """Lowers the fullest window to capacity by moving an item of it to another window, or swapping it
    for one there, in at most ``steps`` steps, and returns the windows' sums."""
    sums = np.array([sum(sizes[i] for i in w) for w in windows], np.int64)
    for _ in range(steps):
        high = int(sums.argmax())
        if sums[high] <= capacity:
            break
        mine = [-1, *windows[high]]
        a = np.array([0, *[sizes[i] for i in windows[high]]])
        for low in np.argsort(sums, kind="stable")[:LOWEST].tolist():
            theirs = [-1, *windows[low]]
            b = np.array([0, *[sizes[i] for i in windows[low]]])
            gain = a[:, None] - b[None, :]
            fullest = np.maximum(sums[high] - gain, sums[low] + gain)
            x, y = divmod(int(fullest.argmin()), len(b))
            if low != high and fullest[x, y] <= capacity:
                windows[high] = [i for i in mine[1:] if i != mine[x]] + [theirs[y]] * (y > 0)
                windows[low] = [i for i in theirs[1:] if i != theirs[y]] + [mine[x]] * (x > 0)
                sums[[high, low]] += [-gain[x, y], gain[x, y]]
                break
        else:
            break
    return sums.tolist()


def windows_of(sizes: list[int], capacity: int, partition: Callable[[list[int], int], list[list[int]]] = differencing) -> list[list[int]]:
    """Whole items (none above capacity) in windows. Their number is the least that can hold the sum at first,
    and rises as long as capacity is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = partition(sizes, k)
        if max(exchange(windows, sizes, capacity, 4 * k), default=0) <= capacity:
            return [sorted(w) for w in windows if w]
        k += 1


class _Packer:
    """Packs the documents of one partition, in order."""

    def __init__(self, capacity: int, block_windows: int, part: int):
        self.capacity, self.target = capacity, block_windows * (capacity - capacity // SLACK)
        self.next_id, self.pending, self.held = part << 32, [], 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield from self._emit([(doc_id, ids, at, at + self.capacity)])
        if whole < len(ids):
            self.pending.append((doc_id, ids, whole, len(ids)))
            self.held += len(ids) - whole
        if self.held >= self.target + 2 * self.capacity:
            yield from self._block(self.target)

    def end(self) -> Iterator[tuple]:
        if self.pending:
            yield from self._block(self.held)

    def _block(self, room: int) -> Iterator[tuple]:
        """Packs pending remainders, in order, of at most room tokens; one that does not fit stays pending."""
        taken, kept = [], []
        for piece in self.pending:
            size = piece[3] - piece[2]
            if size <= room:
                taken.append(piece)
                room -= size
                self.held -= size
            else:
                kept.append(piece)
        self.pending = kept
        for window in windows_of([b - a for _, _, a, b in taken], self.capacity):
            yield from self._emit([taken[i] for i in window])

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, ids, a, b in pieces:
            yield doc_id, a, b - a, ids[a:b].astype("<u4").tobytes(), len(ids), self.next_id, offset
            offset += b - a
        self.next_id += 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 2,
    block_windows: int = 64,
    rows_per_batch: int = 4096,
    coder: Callable[[str], ChunkCoder] = tokenizer_coder,
) -> DataFrame:
    """Packs column ``text`` of docs (``doc_id``, ``text``; further columns are ignored).

    Returns one row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset. A null text counts as empty and holds end_id alone; a text of any length is
    packed whole; a null doc_id is kept; repeated rows are packed each; ties of size go by the order of
    rows; an empty table gives no rows.
    """
    ship_code(docs.sparkSession)

    def run(batches):
        code = coder(tokenizer)
        packer = _Packer(capacity, block_windows, TaskContext.get().partitionId())
        rows: list[tuple] = []
        for batch in tidied(batches):
            doc_ids = batch.column(0).to_pylist()
            for i, ids in code(batch.column(1).to_pylist()):
                rows.extend(packer.add(doc_ids[i], np.append(ids, np.uint32(end_id))))
                if len(rows) >= rows_per_batch:
                    yield _batch(rows)
                    rows = []
        rows.extend(packer.end())
        for at in range(0, len(rows), rows_per_batch):
            yield _batch(rows[at : at + rows_per_batch])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
