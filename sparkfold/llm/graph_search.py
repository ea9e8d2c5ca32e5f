"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Build: points are inserted in growing batches. Each is searched for from the entry point, greedily,
with a beam; what the search visits is pruned robustly: the closest candidate becomes a neighbour
and drops every candidate that is closer to it, by the factor ``alpha``, than to the point, which keeps
a few long and diverse edges. Reverse edges are added, and a list that overflows is pruned alike.
Search: a beam search per query in each shard; the beam's vectors are measured exactly, in double precision.

Equal vectors are one node that carries its rows' ids in order, so a very common vector costs one
node and loses no row. A batch of searches runs in lockstep on arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import best, deal, matrix, usable

DEGREE, BEAM, ALPHA, WIDTH = 32, 64, 1.2, 4


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int, width: int = WIDTH, trail: bool = False):
    """Ids and distances (1 - dot product) of the ``beam`` closest found per query, nearest first (-1: none).

    With trail also all expanded nodes, in columns.
    """
    n, m = len(x), len(q)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    ids, far, done = np.full((m, beam), -1, np.int64), np.full((m, beam), np.inf, np.float32), np.ones((m, beam), bool)
    ids[:, 0], far[:, 0], done[:, 0] = entry, 1 - q @ x[entry], False
    seen[:, entry] = True
    trails, rows = [], np.arange(m)
    while True:
        open_ = ~done
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            break
        pick = open_[rows] & (np.cumsum(open_[rows], axis=1) <= width)
        r, c = np.nonzero(pick)
        done[rows[r], c] = True
        slot = np.arange(len(r)) - np.searchsorted(r, r)
        from_ = np.full((len(rows), width), -1, np.int64)
        from_[r, slot] = ids[rows[r], c]
        if trail:
            whole = np.full((m, width), -1, np.int64)
            whole[rows] = from_
            trails.append(whole)
        near = edges[from_]  # row -1 of edges has no neighbours
        near = np.sort(near.reshape(len(rows), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[rows[:, None], near]] = -1
        a, b = np.nonzero(near >= 0)
        seen[rows[a], near[a, b]] = True
        away = np.full(near.shape, np.inf, np.float32)
        away[a, b] = 1 - np.einsum("ij,ij->i", q[rows[a]], x[near[a, b]])
        all_far = np.concatenate([far[rows], away], axis=1)
        keep = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[rows] = np.take_along_axis(all_far, keep, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], axis=1), keep, axis=1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], near < 0], axis=1), keep, axis=1)
    return (ids, far, np.concatenate(trails, axis=1) if trails else np.zeros((m, 0), np.int64)) if trail else (ids, far)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point from its row of candidates (-1: none)."""
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == points[:, None]] = -1
    there = x[candidates]
    away = 1 - np.einsum("mcd,md->mc", there, x[points])
    away[candidates < 0] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    candidates, away = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(away, order, axis=1)
    there = np.take_along_axis(there, order[:, :, None], axis=1)
    live, out = np.isfinite(away), np.full((len(points), degree), -1, np.int64)
    for k in range(degree):
        rows = np.flatnonzero(live.any(axis=1))
        if not len(rows):
            break
        first = live[rows].argmax(axis=1)
        out[rows, k] = candidates[rows, first]
        between = 1 - np.einsum("mcd,md->mc", there[rows], there[rows, first])
        live[rows] &= alpha * between > away[rows]
        live[rows, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, most: int = 1024) -> tuple[np.ndarray, int]:
    """Neighbour lists (n + 1, degree), the last row empty, and the entry point, of unit vectors x."""
    n = len(x)
    edges = np.full((n + 1, degree), -1, np.int64)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + min(most, max(1, at))]
        *_, trail = found = beam_search(x, edges, entry, x[batch], beam, trail=True)
        candidates = np.concatenate([found[0], trail], axis=1)
        if len(batch) > 1:  # batch mates may be near as well
            like = x[batch] @ x[batch].T
            np.fill_diagonal(like, -np.inf)
            mates = np.argpartition(-like, min(8, len(batch) - 1) - 1, axis=1)[:, : min(8, len(batch) - 1)]
            candidates = np.concatenate([candidates, batch[mates]], axis=1)
        edges[batch] = robust_prune(x, batch, candidates, degree, alpha)
        to = edges[batch].ravel()
        back = np.repeat(batch, degree)[to >= 0]
        to = to[to >= 0]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        heads, first, counts = np.unique(to, return_index=True, return_counts=True)
        room = (edges[heads] < 0).sum(axis=1)
        slot = np.arange(len(to)) - np.repeat(first, counts)
        fits = np.repeat(counts <= room, counts)
        edges[to[fits], (degree - np.repeat(room, counts) + slot)[fits]] = back[fits]
        over = np.flatnonzero(counts > room)
        for k in range(0, len(over), most):  # rows of similar width go together
            mine = over[np.argsort(counts[over], kind="stable")][k : k + most]
            extra = np.full((len(mine), counts[mine].max()), -1, np.int64)
            for i, j in enumerate(mine):
                extra[i, : counts[j]] = back[first[j] : first[j] + counts[j]]
            edges[heads[mine]] = _front(robust_prune(x, heads[mine], np.concatenate([edges[heads[mine]], extra], axis=1), degree, alpha))
        edges[batch] = _front(edges[batch])
        at += len(batch)
    return edges, entry


def _front(lists: np.ndarray) -> np.ndarray:
    """Neighbours first, empty places last."""
    return np.take_along_axis(lists, np.argsort(lists < 0, axis=1, kind="stable"), axis=1)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows."""
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: directions and digits stay, and
    no square is out of range."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


def cosines(v: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of v with y, in double precision; scaling by powers of two changes no digit."""
    v, y = scaled(v), scaled(y)
    return (v * y).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((y * y).sum()))


def index(rows: DataFrame, k: int) -> DataFrame:
    """A graph per (dim, shard) of rows (vec_id, vec, dim, shard): a row per distinct vector.

    dim, shard, node, entry, ids (of its rows, the k + 1 smallest: more can't be among k nearest), vec, edges.
    """

    def run(table: pa.Table) -> pa.Table:
        v, ids = matrix(table.column("vec")), table.column("vec_id").to_numpy()
        by = np.lexsort((ids, *v.T[::-1]))
        v, ids = v[by], ids[by]
        new = np.append(True, (v[1:] != v[:-1]).any(axis=1))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(v)))
        edges, entry = build(unit(v[first]).astype(np.float32))
        n = len(first)
        lists = [ids[a : a + min(c, k + 1)] for a, c in zip(first.tolist(), count.tolist(), strict=True)]
        return pa.table(
            {
                "dim": pa.array(np.full(n, v.shape[1], np.int32)),
                "shard": pa.array(np.full(n, table.column("shard")[0].as_py(), np.int32)),
                "node": pa.array(np.arange(n, dtype=np.int32)),
                "entry": pa.array(np.full(n, entry, np.int32)),
                "ids": pa.array(lists, pa.list_(pa.int64())),
                "vec": pa.array(list(v[first]), pa.list_(pa.float64())),
                "edges": pa.array(list(edges[:n].astype(np.int32)), pa.list_(pa.int32())),
            }
        )

    return rows.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, node int, entry int, ids array<long>, vec array<double>, edges array<int>")


def search(graphs: DataFrame, queries: DataFrame, k: int, shards: int, blocks: int, beam: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each shard."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        left = left.sort_by("node")
        v, lists = matrix(left.column("vec")), left.column("ids").to_pylist()
        edges = np.concatenate([matrix(left.column("edges")).astype(np.int64), np.full((1, DEGREE), -1)])
        single = unit(v).astype(np.float32)
        out: tuple[list, list, list] = ([], [], [])
        names, q = right.column("vec_id").to_numpy(), matrix(right.column("vec"))
        for a in range(0, len(q), 512):
            ids, _ = beam_search(single, edges, left.column("entry")[0].as_py(), unit(q[a : a + 512]).astype(np.float32), beam)
            for name, y, nodes in zip(names[a : a + 512].tolist(), q[a : a + 512], ids, strict=True):
                nodes = nodes[nodes >= 0]
                found = [(-s, i) for s, node in zip(cosines(v[nodes], y).tolist(), nodes.tolist(), strict=True) for i in lists[node] if i != name]
                for s, i in sorted(found)[:k]:
                    out[0].append(name)
                    out[1].append(i)
                    out[2].append(-s)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    key = ["dim", "shard", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = 2 * BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine found for each query, ties to the smaller vec_id.

    vectors and queries have vec_id and embedding; rows of the query's vec_id are no candidates. Only
    vectors of the query's length are compared. Null, empty or zero vectors, and those with a null or
    non-finite component, take no part, nor does a null vec_id. Repeated rows are candidates each, and a query given
    several times is answered once. Empty tables give no rows.
    """
    rows, asked = usable(vectors).filter(F.exists("vec", lambda x: x != 0)), usable(queries).filter(F.exists("vec", lambda x: x != 0)).dropDuplicates(["vec_id"])
    rows, asked, shards, blocks = deal(rows, asked)
    graphs = materialize(index(rows, k))
    return best(search(graphs, asked, k, shards, blocks, beam), k)
