"""Approximate nearest neighbours by cosine: a vantage-point tree per shard.

Vectors are scaled to unit length, where Euclidean distance falls as cosine rises. A node of a tree splits its vectors
at the median distance from a vantage vector, the one of a few whose distances spread most, and keeps the nearest and
farthest distance of either side. By the triangle inequality all of a side is at least as far from a query as the
query's own distance to the vantage lies outside that range. Of a query's leaves the most promising are searched first;
then all others but those whose bound times `factor` exceeds the k-th best distance so far. Factor one passes over only
what cannot hold a neighbour, and so is exact; a larger one passes over more and may miss some. All vectors are indexed;
equal vectors share a place in the tree. What is as near as the k-th but for rounding is kept until the exact scores are
compared, so that ties, as of vectors that are multiples of each other, go by id.

A block of queries goes through a shard's tree together: at each leaf those that may skip it leave. Scores are computed
anew from the original vectors in double precision.

Rows: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; rows of
equal id count once (the smallest vector of each dimension); vectors are compared within their dimension; ties go to the
smaller id; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame

from scenekiln.llm import vectors

#: Vectors of a leaf, vantage vectors that are tried and vectors they are tried on, leaves that a query searches first.
LEAF, TRIED, TRIED_ON, FIRST = 32, 16, 256, 4
#: Allows for rounding where distances are compared.
SLACK = 1e-7
#: Production factor: the largest whole one whose recall against brute force stays over 0.95 (README: factors, recall and
#: share of distances computed).
FACTOR = 6.0


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of one original vector with others; equal rows give equal values."""
    scale = np.abs(query).max()
    query, tops = query / scale, np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / tops
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


class VpTree:
    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        _, first, group = np.unique(matrix, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
        order = np.lexsort((ids, group))
        self.members = np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
        self.first = first
        own = matrix[first] / np.abs(matrix[first]).max(axis=1, keepdims=True)
        self.unit = own / np.sqrt((own * own).sum(axis=1, keepdims=True))
        self.leaves: list[np.ndarray] = []
        self.root = self._split(np.arange(len(first)), np.random.default_rng(len(first)))

    def _split(self, own: np.ndarray, rng: np.random.Generator) -> int | tuple:
        """A leaf's number, or a vantage vector and for both sides the range of distances and the subtree."""
        if len(own) > LEAF:
            tried, on = (rng.choice(own, min(n, len(own)), replace=False) for n in (TRIED, TRIED_ON))
            vantage = int(tried[self._distances(self.unit[tried], on).std(axis=1).argmax()])
            d = self._distances(self.unit[[vantage]], own)[0]
            near = d <= np.median(d)
            if 0 < near.sum() < len(own):
                return vantage, *((d[side].min(), d[side].max(), self._split(own[side], rng)) for side in (near, ~near))
        self.leaves.append(own)
        return len(self.leaves) - 1

    def _distances(self, queries: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (queries @ self.unit[own].T)))

    def _bounds(self, queries: np.ndarray) -> np.ndarray:
        """How far each leaf's vectors are from each query at least."""
        out = np.zeros((len(queries), len(self.leaves)))

        def down(node: int | tuple, bound: np.ndarray) -> None:
            if isinstance(node, int):
                out[:, node] = bound
                return
            d = self._distances(queries, np.array([node[0]]))[:, 0]
            for low, high, child in node[1:]:
                down(child, np.maximum(bound, np.maximum(low - d, d - high)))

        down(self.root, np.zeros(len(queries)))
        return out

    def _search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Places of the k nearest that the search finds for each unit query (-1: none); query and place of all that are
        as near as the k-th; and how many distances were computed."""
        best, place = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1)
        bounds = self._bounds(queries)
        computed = len(queries) * (len(self.leaves) - 1)
        order = np.argsort(bounds, axis=1, kind="stable")[:, :FIRST]
        done = np.zeros(bounds.shape, bool)
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(number: int, asks: np.ndarray) -> None:
            nonlocal computed
            own = self.leaves[number]
            done[asks, number] = True
            own_d = self._distances(queries[asks], own)
            computed += own_d.size
            d, p = np.hstack([best[asks], own_d]), np.hstack([place[asks], np.broadcast_to(own, own_d.shape)])
            first = np.argsort(d, axis=1, kind="stable")[:, :k]
            best[asks], place[asks] = np.take_along_axis(d, first, 1), np.take_along_axis(p, first, 1)
            rows, cols = np.nonzero(own_d <= best[asks, -1:] + SLACK)
            near.append((asks[rows], own[cols], own_d[rows, cols]))

        for turn in range(order.shape[1]):
            for number in np.unique(order[:, turn]):
                visit(number, np.flatnonzero(order[:, turn] == number))
        for number in range(len(self.leaves)):
            asks = np.flatnonzero(~done[:, number] & (bounds[:, number] * factor <= best[:, -1] + SLACK))
            if len(asks):
                visit(number, asks)
        asks, places, d = map(np.concatenate, zip(*near))
        keep = d <= best[asks, -1] + SLACK
        return place, asks[keep], places[keep], computed

    def nearest(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        return self._search(queries, k, factor)[0]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        _, asks, places, _ = self._search(unit, k + 1, factor)  # one may be the query itself
        order = np.argsort(asks, kind="stable")
        for ask, vector, own in zip(ids, queries, np.split(places[order], np.searchsorted(asks[order], np.arange(1, len(ids))))):
            rows = np.concatenate([self.members[p][: k + 1] for p in own])
            rows = rows[self.ids[rows] != ask]
            score = cosines(vector, self.matrix[rows])
            best = np.lexsort((self.ids[rows], -score))[:k]
            yield np.full(len(best), ask), self.ids[rows][best], score[best]


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 5, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row that `is_query` (on `id`) names."""
    if factor < 1:
        raise ValueError("a factor under one would only visit more than an exact search")
    rows = vectors.usable(df, id_col, vector_col, zero_ok=False)
    return vectors.search(rows, is_query, k, VpTree, lambda tree, ids, m: tree.search(ids, m, k, factor), "double")
