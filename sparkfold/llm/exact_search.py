"""Exact top-k by inner product: a dual-tree search over cover trees of queries and of data.

A cover tree's node has a centre, a radius that covers its points, and children whose centres are
further apart than half of it. For a node Q of queries and a node D of data, no inner product exceeds
<q, d> + |q| R_D + |d| R_Q + R_Q R_D (centres q and d, radii R); the pair is pruned when that is below the worst
kth score of Q's queries so far. Vectors are integers; sums below 2**53 are exact in double precision.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best, deal, matrix, usable

#: Points of a leaf, queries of a group, centres drawn at once, and such draws in one node.
LEAF, GROUP, DRAW, DRAWS = 256, 256, 64, 8


class Node:
    """centre, radius, kids (their centres and radii as arrays), loose (numbers of points that are no kid's)."""

    __slots__ = ("centre", "kid_centres", "kid_radii", "kids", "loose", "radius")

    def __init__(self, centre: np.ndarray, radius: float, kids: list, loose: np.ndarray):
        self.centre, self.radius, self.kids, self.loose = centre, radius, kids, loose
        if kids:
            self.kid_centres, self.kid_radii = np.stack([c.centre for c in kids]), np.array([c.radius for c in kids])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def cover_tree(points: np.ndarray, numbers: np.ndarray, first: int, leaf: int) -> Node:
    """The cover tree of points[numbers] around points[first].

    Centres half a radius apart are drawn in order, DRAW candidates at a time; a point goes to the first
    centre within half the radius. Points that are no centre's, or alone, stay loose points of the node:
    where the space is so wide that nearly all are, DRAWS draws end it.
    """
    centre = points[first]
    radius = float(_distances(points[numbers], centre[None, :]).max())
    if len(numbers) <= leaf or radius == 0:
        return Node(centre, radius, [], numbers)
    kids, loose, left = [], [], numbers[numbers != first]
    left = np.concatenate([[first], left])
    for _ in range(DRAWS):
        if not len(left):
            break
        apart = _distances(points[left[:DRAW]], points[left[:DRAW]]) > radius / 2
        chosen: list[int] = []
        for i in range(len(apart)):
            if apart[i, chosen].all():
                chosen.append(i)
        near = _distances(points[left], points[left[chosen]]) <= radius / 2
        near[chosen, np.arange(len(chosen))] = True
        goes = np.where(near.any(axis=1), near.argmax(axis=1), -1)
        goes[chosen] = np.arange(len(chosen))
        for j, c in enumerate(left[chosen].tolist()):
            mine = left[goes == j]
            if len(mine) == 1:
                loose.append(mine)
            elif len(mine) == len(numbers):  # rounding kept all within half the radius
                loose.append(mine)
            else:
                kids.append(cover_tree(points, mine, c, leaf))
        left = left[goes < 0]
    return Node(centre, radius, kids, np.concatenate([*loose, left]).astype(np.int64))


class DualTree:
    """The k best data rows per query: larger score first, ties to the smaller id."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
        self.data, self.ids, self.queries, self.own, self.k = data, ids, queries, own, k
        self.scores, self.found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1, np.int64)
        self.pairs = 0

    def run(self) -> None:
        if len(self.data) and len(self.queries):
            self.sizes = np.sqrt((self.queries * self.queries).sum(axis=1))
            tree = cover_tree(self.data, np.arange(len(self.data)), 0, LEAF)
            self._descend(cover_tree(self.queries, np.arange(len(self.queries)), 0, GROUP), tree)

    def _descend(self, q: Node, tree: Node) -> None:
        """Searches for the leaves of the query tree, and for a node's loose queries as one group."""
        for kid in q.kids:
            self._descend(kid, tree)
        for at in range(0, len(q.loose), GROUP):
            self._visit(q, q.loose[at : at + GROUP], tree)

    def _visit(self, q: Node, members: np.ndarray, tree: Node) -> None:
        size = float(np.sqrt((q.centre * q.centre).sum()))
        stack = [(np.inf, tree)]
        while stack:
            bound, d = stack.pop()
            if bound < self.scores[members, -1].min():
                continue
            self._compare(members, d.loose)
            if d.kids:
                worst = self.scores[members, -1]
                lengths = np.sqrt((d.kid_centres * d.kid_centres).sum(axis=1))
                bounds = d.kid_centres @ q.centre + (size * d.kid_radii + lengths * q.radius + q.radius * d.kid_radii) * (1 + 1e-9) + 1e-6
                live = np.flatnonzero(bounds >= worst.min())
                # Of the pairs that pass, each query's own bound.
                each = self.queries[members] @ d.kid_centres[live].T + self.sizes[members][:, None] * d.kid_radii[live] * (1 + 1e-9) + 1e-6
                live = live[(each >= worst[:, None]).any(axis=0)]
                for i in live[np.argsort(bounds[live], kind="stable")].tolist():  # the most promising is popped first
                    stack.append((bounds[i], d.kids[i]))

    def _compare(self, members: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            self.pairs += len(members) * len(part)
            scores = self.queries[members] @ self.data[part].T
            fit = (scores >= self.scores[members, -1][:, None]) & (self.ids[part] != self.own[members][:, None])
            for j in np.flatnonzero(fit.any(axis=1)).tolist():
                m, pick = members[j], np.flatnonzero(fit[j])
                if len(pick) > 8 * self.k:  # all that tie with the kth best stay
                    s = scores[j, pick]
                    pick = pick[s >= np.partition(s, len(s) - self.k)[len(s) - self.k]]
                all_s, all_i = np.append(self.scores[m], scores[j, pick]), np.append(self.found[m], self.ids[part[pick]])
                order = np.lexsort((all_i, -all_s))[: self.k]
                self.scores[m], self.found[m] = all_s[order], all_i[order]


def _exact(v: np.ndarray, w: np.ndarray) -> bool:
    """Whether all products and sums of rows of v and w are exact in double precision."""
    top = max((float(np.abs(a).max()) for a in (v, w) if a.size), default=0.0)
    return top * top * v.shape[1] < 2.0**53


def _by_integers(data: np.ndarray, asked: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, scale: int, names: list[str]) -> pa.Table:
    """The k best per query by products of Python's integers, a query at a time."""
    whole = lambda v: [math.floor(scale * x) if abs(x) < 2.0**60 else scale * int(x) for x in v]
    rows = np.array([whole(v) for v in data.tolist()], object)
    out: tuple[list, list, list] = ([], [], [])
    for name, q in zip(own.tolist(), asked.tolist(), strict=True):
        scores = rows @ np.array(whole(q), object)
        for s, i in heapq.nsmallest(k, ((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != name)):
            for column, value in zip(out, (name, i, max(-(1 << 63), min((1 << 63) - 1, -s))), strict=True):
                column.append(value)
    return pa.table([pa.array(c, pa.int64()) for c in out], names=names)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product of floor(scale * x), ties to the smaller vec_id.

    vectors and queries have vec_id and embedding; rows of the query's vec_id are no candidates. Only
    vectors of the query's length are compared. Null or empty vectors, those with a null or non-finite
    component, and null vec_ids take no part. Repeated rows are candidates each, and a query given several
    times is answered once. Where sums may exceed what double precision holds exactly, integers of any size
    are multiplied without pruning, and a score beyond a long is given as the nearest long. Empty tables
    give no rows.
    """

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        ids, own = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        with np.errstate(over="ignore"):
            data, asked = (np.floor(scale * matrix(t.column("vec"))) for t in (left, right))
        tree = DualTree(data, ids, asked, own, k)
        if not _exact(data, asked):
            return _by_integers(*(matrix(t.column("vec")) for t in (left, right)), ids, own, k, scale, names)
        tree.run()
        at, rank = np.nonzero(np.isfinite(tree.scores))
        return pa.table([pa.array(own[at]), pa.array(tree.found[at, rank]), pa.array(tree.scores[at, rank].astype(np.int64))], names=names)

    rows, asked, shards, blocks = deal(usable(vectors), usable(queries).dropDuplicates(["vec_id"]))
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    by = ["dim", "shard", "block"]
    return best(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score long"), k)
