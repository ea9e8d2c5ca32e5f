import numpy as np
import pytest

from sparkfold.llm import vectors as dealing
from sparkfold.llm.exact_search import DualTree, cover_tree, top_k
from sparkfold.llm.graph_search import beam_search, build, nearest, robust_prune, unit


def clustered(n, d=16, seed=0, spread=0.15):
    r = np.random.default_rng(seed)
    return (r.normal(size=(12, d))[r.integers(0, 12, n)] + spread * r.normal(size=(n, d))).astype(np.float32)


def frame(spark, v, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in row], 0) for i, row in zip(ids if ids is not None else range(len(v)), v)], "vec_id long, embedding array<float>, label int")


ODD = [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan"), 1.0, 0.0, 0.0]), (905, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(dealing, "SHARD_ROWS", 300)
    monkeypatch.setattr(dealing, "BLOCK_ROWS", 8)


def test_robust_prune_keeps_diverse_neighbours():
    x = unit(np.array([[1, 0.0], [1, 0.1], [1, 0.11], [1, -0.2]]))
    assert set(robust_prune(x, np.array([0]), np.array([[1, 2, 3, 0, 1]]), 4, 1.2)[0].tolist()) == {1, 3, -1}


def test_beam_search_finds_all_of_a_small_graph():
    x = unit(clustered(60)).astype(np.float32)
    edges, entry = build(x)
    ids, _ = beam_search(x, edges, entry, x[:5], 60)
    assert all(set(row.tolist()) >= set(range(60)) for row in ids)


def test_recall_against_brute_force(spark, small_shards):
    v = clustered(1500, spread=0.6)
    df = frame(spark, v)
    got = nearest(df, df.filter("vec_id % 50 = 0")).collect()
    x = unit(v.astype(np.float64))
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12 and r.vec_id != r.query_id
    hits = 0
    for q in range(0, 1500, 50):
        s = x @ x[q]
        s[q] = -2
        hits += len({i for _, i in found[q]} & set(np.argsort(-s, kind="stable")[:5].tolist()))
        assert [r for r, _ in sorted(found[q])] == [1, 2, 3, 4, 5]
    assert hits / (30 * 5) >= 0.9


def test_ties_copies_and_few_candidates(spark):
    df = frame(spark, np.array([[1, 0, 0, 0]] * 40 + [[0, 1, 0, 0]], np.float32))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest(df, df.filter("vec_id = 20")).collect())
    assert got == [(20, k + 1, k) for k in range(5)]
    got = sorted((r.rank, r.vec_id, r.score) for r in top_k(df, df.filter("vec_id = 20")).collect())
    assert got == [(k + 1, k, 65536) for k in range(5)]
    few = frame(spark, np.eye(4, dtype=np.float32)[:3])
    assert nearest(few, few.filter("vec_id = 0")).count() == 2 and top_k(few, few.filter("vec_id = 0")).count() == 2


def test_odd_vectors_take_no_part(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 0.0, 0.5], "x") for i in range(8)] + [(*r, "x") for r in ODD] + [(1, [1.0, 1.0, 0.0, 0.5], "x"), (50, [1.0, 2.0], "y"), (51, [2.0, 1.0], "y")], "vec_id long, embedding array<double>, score string")
    out = nearest(df, df).collect()
    assert {r.query_id for r in out} == {*range(8), 50, 51} >= {r.vec_id for r in out} and {r.vec_id for r in out if r.query_id == 50} == {51}
    out = top_k(df, df).collect()
    assert {r.query_id for r in out} == {*range(8), 50, 51, 902} and all(r.rank <= 5 for r in out)
    none = df.limit(0)
    assert nearest(none, none).count() == 0 and top_k(none, none).count() == 0


def brute_top(data, ids, queries, own, k):
    out = []
    for q, o in zip(queries, own):
        s = data @ q
        order = np.lexsort((ids, -s))
        out.append([(int(s[i]), int(ids[i])) for i in order if ids[i] != o][:k])
    return out


def test_cover_tree_covers_every_point_once():
    points = np.floor(256 * clustered(3000).astype(np.float64))
    seen = []

    def walk(node):
        members = list(node.loose)
        for kid in node.kids:
            members += walk(kid)
        assert (np.sqrt(((points[members] - node.centre) ** 2).sum(axis=1)) <= node.radius + 1e-6).all()
        return members

    seen = walk(cover_tree(points, np.arange(3000), 0, 32))
    assert sorted(seen) == list(range(3000))


def test_dual_tree_equals_brute_force_and_prunes():
    for seed, spread in ((1, 0.02), (2, 0.5)):
        data = np.floor(256 * clustered(6000, 8, seed, spread).astype(np.float64))
        data[100:160] = data[100]
        ids = np.random.default_rng(seed).permutation(6000)
        tree = DualTree(data, ids, data[:400], ids[:400], 5)
        tree.run()
        want = brute_top(data, ids, data[:400], ids[:400], 5)
        assert [[(int(s), int(i)) for s, i in zip(a, b)] for a, b in zip(tree.scores, tree.found)] == want
        if spread < 0.1:
            assert tree.pairs < 0.6 * 6000 * 400


def test_top_k_over_shards_equals_brute_force(spark, small_shards):
    v = clustered(1200, 8, 3, 0.4)
    df = frame(spark, v)
    got = {}
    for r in top_k(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    data = np.floor(256 * v.astype(np.float64))
    want = brute_top(data, np.arange(1200), data[::50], np.arange(0, 1200, 50), 5)
    assert {q: [(s, i) for _, s, i in sorted(x)] for q, x in got.items()} == dict(zip(range(0, 1200, 50), want))


def test_large_components_use_integers(spark):
    df = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e7, 3.0]), (2, [-1e7, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 2560000000**2 + 256 * 768), (2, 2, -(2560000000**2))]


def test_components_of_any_magnitude(spark):
    rows = [(0, [1e308, -1.0]), (1, [1e308, 5.0]), (2, [1e-308, 0.0]), (3, [-1e300, 1.0]), (4, [3e200, 4e200]), (5, [3e-200, 4e-200]), (6, [5e-324, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in top_k(df, df.filter("vec_id = 0"), k=9).collect()}
    assert got[1] == got[4] == (1 << 63) - 1 and got[3] == -(1 << 63) and got[2] == 0 and len(got) == 6
    found = {(r.query_id, r.vec_id): r.score for r in nearest(df, df, k=6).collect()}
    assert found[4, 5] == found[5, 4] == pytest.approx(1.0, abs=1e-15) and found[0, 4] == pytest.approx(0.6) and found[6, 2] == pytest.approx(0.5**0.5)
