import random
from collections import Counter

import numpy as np

from sparkfold.llm.near_dedup import _units, components, dart_minhash, near_duplicate_classes, similar
from sparkfold.llm.words import sequence_hashes, shingles, word_hashes
from tests.llm.conftest import WORDS, prose


def brute(rows, least=0.8):
    """Classes by comparing all pairs of shingle counts."""

    def counts(text):
        w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets = {i: counts(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if not x or not y:
                continue
            n, m, shared = len(x), len(y), len(x.keys() & y.keys())
            weighted = sum((x & y).values()) / sum((x | y).values())
            if shared >= least * (n + m - shared) or weighted >= least:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_words_and_shingles():
    words, upto = word_hashes([b"One two, THREE!", b"", "one  two three éa".encode(), b"a b c d e f a b c d e f"])
    assert np.diff(upto).tolist() == [3, 0, 4, 12] and words[0] == words[3] and words[2] == words[5]
    h1, _ = sequence_hashes(words, upto)
    assert len(set(h1.tolist())) == 4
    owner, hashes, occurrence = shingles(words, upto)
    assert np.bincount(owner, minlength=4).tolist() == [1, 0, 1, 8]
    assert occurrence[owner == 3].max() == 1


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(3)
    hashes = r.integers(0, 1 << 62, 900).astype(np.uint64)
    a, b = np.repeat(hashes[:500], 2), np.repeat(hashes[100:600], 2)
    occurrence = np.tile([0, 1], 500)
    owner = np.repeat([0, 1], 1000)
    units = _units(np.concatenate([a, b]), np.concatenate([occurrence, occurrence]))
    s = dart_minhash(owner, units, 2, 2048)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.05


def test_similar_is_exact_at_the_threshold():
    x = np.arange(100, dtype=np.uint32)
    y = np.concatenate([x[:89], np.arange(1000, 1011, dtype=np.uint32)])
    assert similar(x.tobytes(), 100, y.tobytes(), 100, 0.8) == (89 / 111 >= 0.8)
    assert not similar(x.tobytes(), 100, y[:80].tobytes() + y[:1].tobytes(), 81, 0.9)


def test_components_in_one_task_and_in_rounds(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    df = spark.createDataFrame(edges, "a long, b long").filter("a <> b")
    one = {(x.node, x.label) for x in components(df).collect()}
    assert one == {(x.node, x.label) for x in components(df, bound=0).collect()}
    assert all(label == 400 for node, label in one if node >= 400)


def test_classes_equal_brute_force(spark):
    r, rows = random.Random(5), []
    for group in range(6):
        base = prose(200, group).split()
        for copy in range(12):
            words = list(base)
            for _ in range(r.randrange(0, 14)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, prose(150, 100 + i)) for i in range(30)]
    got = {x.doc_id: x.class_id for x in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_a_text_between_its_copies_joins_them(spark):
    base = [f"w{i}" for i in range(300)]
    copies = []
    for c in range(40):  # each is near the base, but not near the others
        words = list(base)
        for k in range(6):
            words[(c * 7 + k * 47) % 300] = f"x{c}_{k}"
        copies.append((c, " ".join(words)))
    rows = [*copies, (99, " ".join(base))]
    got = {x.doc_id: x.class_id for x in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_documents(spark, odd_docs):
    got = [(x.doc_id, x.class_id) for x in near_duplicate_classes(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    found = {}
    for i, c in got:
        found.setdefault(i, []).append(c)
    assert found[0] == found[1] == found[2] == [0] and found[3] == [3] and found[4] == [4] and found[5] == [5, 5]
    assert sorted(found[None], key=str) == [0, None]
    assert near_duplicate_classes(odd_docs.limit(0)).count() == 0


def brute_of_sets(sets, least=0.8):
    """Classes of sets without repeated shingles."""
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if label[i] != label[j] and shared >= least * (len(x) + len(sets[j]) - shared):
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    return dict(enumerate(label))


def test_links_inside_a_large_family(spark):
    rows = []
    for i in range(1000):  # all share a passage (similarity 0.77); 0 and 1, 2 and 3 up to 19 a little more (0.82)
        shared = f"p{i // 2}x" if i < 20 else f"q{i}x"
        own = [f"{shared if k < 3 else f'o{i}x'}{k}" for k in range(14)]
        rows.append((i, " ".join([f"w{k}" for k in range(100)] + own)))
    got = {x.doc_id: x.class_id for x in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = [t.split() for _, t in rows]
    number = {}
    want = brute_of_sets([{number.setdefault(tuple(w[k : k + 5]), len(number)) for k in range(len(w) - 4)} for w in words])
    assert len(set(want.values())) == 990
    assert got == want


def test_texts_that_repeat_shingles_in_different_numbers(spark):
    line = [f"a{k} b{k} c{k} d{k} e{k} f{k} g{k}" for k in range(12)]
    rows = [(k, " ".join([line[k]] * 10)) for k in range(12)] + [(100 + k, " ".join([line[k]] * (20 + 3 * k))) for k in range(12)]
    got = {x.doc_id: x.class_id for x in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[105] == 5  # the distinct shingles agree


def test_rounds_of_hubs_change_the_cost_alone(spark):
    r, rows = random.Random(8), []
    for family in range(3):  # variants of a text, most pairs of which are just below the threshold
        base = [f"w{family}_{k}" for k in range(200)]
        for _ in range(60):
            words = list(base)
            for k in r.sample(range(200), r.randrange(1, 6)):
                words[k] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 1 < len(set(want.values())) < len(rows)
    for rounds in (0, 2):
        assert {x.doc_id: x.class_id for x in near_duplicate_classes(df, hub_rounds=rounds).collect()} == want
