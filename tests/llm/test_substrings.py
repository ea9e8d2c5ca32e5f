import random
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import Row

from sparkfold.llm import substrings
from sparkfold.llm.substrings import remove_repeats


def brute(rows, width):
    owner = {}
    for i, t in rows:
        b = (t or "").encode()
        key = float("inf") if i is None else i
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            owner[w] = min(owner.get(w, float("inf")), key)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        key = float("inf") if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if owner[b[p : p + width]] < key:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for q in range(len(b)) if gone[q] and not (q and gone[q - 1]))
        out.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g), spans))
    return sorted(out, key=str)


def run(spark, rows, width=50):
    df = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in rows], "doc_id long, text string").repartition(3)
    return sorted([(r.doc_id, r.n_bytes, bytes(r.kept), len(r.starts)) for r in remove_repeats(df, width=width).collect()], key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    shared = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [r.choice(shared) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 5))]
        rows.append((i, r.choice(["", " "]).join(parts)))
    return rows + [(50, rows[3][1]), (51, "a" * 700), (52, "a" * 300 + "b" * 60), (53, None), (54, ""), (55, "é" * 25), (56, "é" * 26), (57, "x" * 49)]


def test_equals_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows, 50)


def test_repeated_ids_null_ids_and_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here "
    rows = [(1, text), (1, text + text), (1, text), (2, text), (2, text), (None, text), (None, "z" + text), (3, "none of it")]
    assert run(spark, rows) == brute(rows, 50)


def test_rows_of_null_ids_are_told_apart(spark):
    r, twins = random.Random(11), {}  # two texts of equal length and checksum
    while True:
        text = "x" * 60 + "".join(r.choice("abcdefgh") for _ in range(14))
        other = twins.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            break
    rows = [(None, text), (None, other), (None, "y" * 90), (4, "z" + "x" * 55), (None, "q" * 90 + "w")]
    assert run(spark, rows) == brute(rows, 50)


def test_equal_prints_are_resolved_by_the_bytes():
    data = np.frombuffer(b"0123456789" * 6 + b"abcdefghij" * 6 + b"0123456789" * 6, np.uint8)
    start, length = np.array([0, 60, 120]), np.array([60, 60, 60])
    first, which = substrings.distinct(data, start, length, np.zeros(3, np.uint64))
    assert which.tolist() == [0, 1, 0] and first.tolist() == [0, 1]
    first, which = substrings.distinct(data, start, length, np.array([5, 9, 5], np.uint64))
    assert which.tolist() == [0, 1, 0] and first.tolist() == [0, 1]


def test_suffixes_are_in_lexicographic_order():
    r = random.Random(3)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(400)).encode() + b"abc" * 100 + b"abc" * 100, np.uint8)
    at = np.arange(len(data) - 49)
    order, new = substrings.suffix_order(data, at, 50)
    texts = [data[i : i + 50].tobytes() for i in order]
    assert texts == sorted(texts) and sorted(order.tolist()) == at.tolist()
    assert new.tolist() == [k == 0 or texts[k] != texts[k - 1] for k in range(len(texts))]


def test_windows_of_any_width_and_shared_beginnings_are_ordered():
    r = random.Random(5)
    text = b"".join(r.choice([b"the same long beginning of many windows ", b"\0\0\0\0\0\0\0\0\0", bytes([r.randrange(256)]), b"\xff" * 12]) for _ in range(300))
    data = np.frombuffer(text, np.uint8)
    assert substrings.big_endian_words(data).tolist() == [int.from_bytes(text[i : i + 8].ljust(8, b"\0"), "big") for i in range(len(text))]
    for width in (3, 8, 9, 50, 64):
        at = np.arange(len(data) - width + 1)
        order, new = substrings.suffix_order(data, at, width)
        texts = [text[i : i + width] for i in order]
        assert texts == sorted(texts) and sorted(order.tolist()) == at.tolist()
        assert new.tolist() == [k == 0 or texts[k] != texts[k - 1] for k in range(len(texts))]


def test_bytes_are_gathered_without_a_place_for_each():
    data = np.frombuffer(random.Random(6).randbytes(1 << 20), np.uint8)
    length = np.tile([70, 0, 113], 14_000)
    start = np.random.default_rng(6).integers(0, len(data) - 113, len(length))
    tracemalloc.start()
    got = substrings.gather(data, start, length)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tobytes() == b"".join(data[s : s + n].tobytes() for s, n in zip(start.tolist(), length.tolist()))
    assert peak < 3 * len(got)  # 16 bytes of places for each byte before
    assert len(substrings.gather(data, start[:0], length[:0])) == len(substrings.gather(data, start[:1], length[1:2])) == 0


def test_phrases_hold_every_window_once_whatever_the_pieces(monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice("abc ") for _ in range(r.choice([0, 3, 49, 50, 51, 300, 2000]))).encode() for _ in range(30)] + [b"a" * 500]
    ends, data = np.cumsum([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8)
    want = [p for e, t in zip(ends, texts) for p in range(e - len(t), e - 49)]
    for size in (64, 1000, 1 << 20):
        monkeypatch.setattr(substrings, "PIECE_BYTES", size)
        start, windows, _, _ = substrings.phrases(data, ends, 50)
        assert sorted(p for s, w in zip(start.tolist(), windows.tolist()) for p in range(s, s + w)) == want


def test_bundles_pieces_and_levels_change_nothing(spark, monkeypatch):
    rows = corpus(7)
    want = brute(rows, 50)
    assert substrings.fans(64, 4096) == [64] and substrings.fans(64, 4) == [4, 16, 64] and substrings.fans(65, 4)[-1] >= 65
    df = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in rows], "doc_id long, text string").repartition(2)
    for fan in (4, 4096):
        found = remove_repeats(df, fan=fan).collect()
        assert sorted([(r.doc_id, r.n_bytes, bytes(r.kept), len(r.starts)) for r in found], key=str) == want
    texts = dict(rows)
    for r in found:
        raw, gone = (texts[r.doc_id] or "").encode(), bytearray()
        for s, e in zip(r.starts, r.ends):
            gone += raw[s:e]
        assert len(gone) + len(r.kept) == len(raw) and sorted(r.starts) == r.starts


def test_bundles_of_any_size_hold_all_rows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUNDLE_BYTES", 500)
    docs = spark.createDataFrame(corpus(5), "doc_id long, text string").selectExpr("doc_id", "cast(coalesce(text, '') as binary) as text").coalesce(1)
    batches = docs.toArrow().to_batches(max_chunksize=7)
    monkeypatch.setattr(substrings.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    kept = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: kept.setdefault("run", run))
    substrings._bundles(docs)
    out = [(b.column("bundle")[0].as_py(), *substrings.unpack_arrays(b.column("blob")[0].as_py())) for b in kept["run"](batches)]
    assert [n for n, *_ in out] == [(3 << 32) + k for k in range(len(out))] and len(out) > 3
    assert [i for _, ids, *_ in out for i in ids.tolist()] == [i for i, _ in corpus(5)]
    assert b"".join(d.tobytes() for *_, d in out) == "".join(t or "" for _, t in corpus(5)).encode()


def test_empty_table(spark, odd_docs):
    assert remove_repeats(odd_docs.limit(0)).count() == 0
    assert remove_repeats(odd_docs).count() == odd_docs.count()
