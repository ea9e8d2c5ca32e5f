import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfold.llm.common import _strings
from sparkfold.llm.packing import _Packer, differencing, exchange, pack, tokenizer_coder, windows_of
from sparkfold.llm.queries import default_tokenizer

TOKENIZER = default_tokenizer()


@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 6))
def test_differencing_parts_all_items_and_is_no_worse_than_greedy(sizes, k):
    windows = differencing(sizes, k)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - (min(sums) if len(sums) == k else 0) <= max(sizes) or max(sums) <= max(sum(sizes) / k + max(sizes), max(sizes))


def test_differencing_balances_a_known_case():
    windows = differencing([8, 7, 6, 5, 4], 2)
    assert abs(sum([8, 7, 6, 5, 4][i] for i in windows[0]) - 15) <= 1


@settings(max_examples=50)
@given(st.lists(st.integers(0, 100), max_size=40))
def test_windows_are_gapless_full_and_lose_nothing(lengths):
    packer, rows = _Packer(16, 4, 0), []
    for i, n in enumerate(lengths):
        rows += packer.add(i, np.arange(n, dtype=np.uint32))
    rows += packer.end()
    parts, windows = defaultdict(list), defaultdict(list)
    for doc, start, length, ids, total, window, offset in rows:
        assert total == lengths[doc] and np.frombuffer(ids, "<u4").tolist() == list(range(start, start + length))
        parts[doc].append((start, length))
        windows[window].append((offset, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(parts[doc]):
            assert start == at
            at += length
        assert at == n
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 16


def _lengths(n: int, seed: int) -> list[int]:
    r = np.random.default_rng(seed)
    return np.clip(r.lognormal(5.6, 1.0, n), 1, 60_000).astype(int).tolist()


def test_only_documents_beyond_a_window_are_cut_and_padding_is_small():
    lengths, packer, rows = _lengths(20_000, 1), _Packer(4096, 64, 0), []
    for i, n in enumerate(lengths):
        rows += packer.add(i, np.zeros(n, np.uint32))
    rows += packer.end()
    assert len(rows) == sum(-(-n // 4096) for n in lengths)  # whole windows and one remainder
    sums = Counter()
    for r in rows:
        sums[r[5]] += r[2]
    assert sum(sums.values()) == sum(lengths) and max(sums.values()) <= 4096
    assert sum(lengths) / (4096 * len(sums)) > 0.985


def test_differencing_decides_how_many_windows_there_are():
    sizes = [n % 4096 for n in _lengths(700, 2) if n % 4096]
    sizes = sizes[: next(i for i in range(len(sizes)) if sum(sizes[: i + 1]) > 63 * 4096)]
    robin = lambda s, k: [list(range(j, len(s), k)) for j in range(k)]
    assert len(windows_of(sizes, 4096)) <= 65 and len(windows_of(sizes, 4096, robin)) > 75
    spread = lambda w: max(sum(sizes[i] for i in x) for x in w) - min(sum(sizes[i] for i in x) for x in w)
    assert spread(differencing(sizes, 64)) < 200 < 2000 < spread(robin(sizes, 64))


def test_the_window_count_rises_when_capacity_is_exceeded():
    assert len(windows_of([60, 60, 60], 100)) == 3  # two windows would hold the sum
    assert windows_of([], 100) == [] and len(windows_of([100, 50, 50], 100)) == 2


def test_the_window_count_starts_with_the_least_that_holds_the_sum():
    for n in (2, 3, 8):
        assert len(windows_of([4096, 2048, 2048] * n, 4096)) == 2 * n
    packer, rows = _Packer(4096, 64, 0), []
    for i in range(8):
        rows += packer.add(i, np.zeros(2048, np.uint32))
    rows += packer.end()
    assert len({r[5] for r in rows}) == 4


def test_chunks_become_a_list_of_strings():
    for chunks in ([], [""], ["a"], ["", "é", "x" * 50, "中文", "\x1c", "\x00", ""]):
        assert _strings(pa.array(chunks, pa.large_string())) == chunks


@given(st.lists(st.integers(1, 50), min_size=1, max_size=30))
def test_exchanges_keep_the_items(sizes):
    windows = [list(range(j, len(sizes), 4)) for j in range(4)]
    sums = exchange(windows, sizes, max(50, -(-sum(sizes) // 4)), 16)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and sums == [sum(sizes[i] for i in w) for w in windows]


@pytest.mark.parametrize(
    "text", ["", " ", "Don't can't 'tis we're", "<|endoftext|> x<|endoftext|>y,", "a…, b’, c', ΣΑΣ İstanbul straße ﬁ", "12a3 a_b ... ## a.b c,, \x1c\x0b d e 中文字 é Å", "x" * 3000, "A" * 50 + "!" * 500]
)
def test_chunked_ids_equal_the_tokenizers(text):
    from tokenizers import Tokenizer

    got = list(tokenizer_coder(TOKENIZER)([text, None, text + " b"]))
    want = [Tokenizer.from_file(TOKENIZER).encode(t, add_special_tokens=False).ids for t in (text, "", text + " b")]
    assert [i for i, _ in got] == [0, 1, 2] and [ids.tolist() for _, ids in got] == want


def test_a_text_beyond_a_slice_is_coded_whole():
    coder = tokenizer_coder(TOKENIZER)
    old, coder.slice_bytes = coder.slice_bytes, 64
    try:
        text = "one two three four five six seven eight nine ten " * 20
        whole = list(coder([text]))[0][1].tolist()
    finally:
        coder.slice_bytes = old
    assert whole == list(coder([text]))[0][1].tolist()


def test_pack_on_odd_documents(spark, odd_docs):
    rows = pack(odd_docs, TOKENIZER, capacity=256).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.doc_id] += r.length
        assert r.length * 4 == len(r.ids) and r.length <= 256
    assert tokens[3] == tokens[4] == 1  # the end alone
    assert tokens[5] == 4  # two rows of one token and its end
    assert tokens[7] > 30_000 and tokens[None] > 0
    assert sum(1 for r in rows if r.doc_id == 3 and zlib.crc32(bytes(r.ids)) == zlib.crc32((2).to_bytes(4, "little"))) == 1
    assert pack(odd_docs.limit(0), TOKENIZER).count() == 0
