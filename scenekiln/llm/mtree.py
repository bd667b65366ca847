"""Exact top-k by integer inner product: an M-tree per shard, searched best first.

The largest inner product is turned into the nearest vector: each vector gets one more component, so that all have the
length of the shard's longest; a query gets 0 there. Its distance to a vector then falls as their product rises.

A tree has pages: leaf pages of entries with their distance to the page's routing vector, and inner pages of leaf pages
with covering radius and distance to the inner routing vector. A block of queries searches together, each query in its
own best-first order of lower bounds. Stored distances bound what need not be computed: a page is passed over if
|d(q, parent) - d(page, parent)| - radius exceeds the query's k-th distance, before its own distance is computed, and an
entry if |d(q, page) - d(entry, page)| does. The search ends for a query when its next bound exceeds its k-th distance.
Products are then computed exactly in integers.

Rows: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; zero vectors do;
rows of equal id count once (the smallest vector of each dimension); vectors are compared within their dimension; ties
go to the smaller id; components stop at 1e150 and products at the ends of a long; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame

from scenekiln.llm import vectors

PAGE = 32
#: Relative rounding of squared distances that bounds allow for.
SLACK = 1e-9


def products(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued vectors."""
    if (np.abs(rows) @ np.abs(query) < 2.0**53).all():
        return (rows @ query).astype(np.int64)
    wide = [sum(int(a) * int(b) for a, b in zip(query, r)) for r in rows]
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in wide], np.int64)


def _grouped(points: np.ndarray, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Groups of at most `size` near points, by splitting at the median between two far ones."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            done.append(own)
            continue
        a = points[rng.choice(own)]
        b = points[own[np.argmax(((points[own] - a) ** 2).sum(axis=1))]]
        order = own[np.argsort(points[own] @ (b - a), kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


class MTree:
    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        lengths = (matrix * matrix).sum(axis=1)
        self.top = float(lengths.max())
        points = np.hstack([matrix, np.sqrt(np.maximum(0, self.top - lengths))[:, None]])
        _, first, group = np.unique(matrix, axis=0, return_index=True, return_inverse=True)
        order = np.lexsort((ids, group.ravel()))
        self.members = np.split(order, np.flatnonzero(np.diff(group.ravel()[order])) + 1)
        self.points = points[first]
        rng = np.random.default_rng(len(first))
        self.leaves = _grouped(self.points, PAGE, rng)
        self.routes = np.stack([self.points[own].mean(axis=0) for own in self.leaves])
        self.stored = [self._apart(r[None], self.points[own])[0] for r, own in zip(self.routes, self.leaves)]
        self.radii = np.array([s.max() for s in self.stored])
        self.inner = _grouped(self.routes, PAGE // 2, rng)
        self.parents = np.stack([self.routes[own].mean(axis=0) for own in self.inner])
        self.parent_of = np.empty(len(self.leaves), np.int64)
        for i, own in enumerate(self.inner):
            self.parent_of[own] = i
        self.to_parent = self._apart(self.parents[self.parent_of], self.routes, paired=True)
        self.cover = np.array([(self.to_parent[own] + self.radii[own]).max() for own in self.inner])

    def _apart(self, a: np.ndarray, b: np.ndarray, paired: bool = False) -> np.ndarray:
        if paired:
            return np.sqrt(((a - b) ** 2).sum(axis=1))
        return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)))

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        """Places of each query's k points of largest product, ties to the smaller least id; -1: none. And how many
        distances and products were computed."""
        asks = np.hstack([queries, np.zeros((len(queries), 1))])
        squares = (asks * asks).sum(axis=1) + self.top
        slack = np.sqrt(SLACK * squares)
        d = self._apart(asks, self.parents)
        bound = np.maximum(0, d - self.cover)[:, self.parent_of]
        bound = np.maximum(bound, np.abs(d[:, self.parent_of] - self.to_parent) - self.radii)
        order = np.argsort(bound, axis=1, kind="stable")
        least = np.array([self.ids[m[0]] for m in self.members])
        best, best_id = np.full((len(asks), k), -np.inf), np.full((len(asks), k), np.iinfo(np.int64).max)
        place, tau = np.full((len(asks), k), -1), np.full(len(asks), np.inf)
        computed, alive = d.size, np.arange(len(asks))
        for turn in range(len(self.leaves)):
            page = order[alive, turn]
            alive, page = (x[bound[alive, page] <= tau[alive] + slack[alive]] for x in (alive, page))
            if not len(alive):
                break
            for leaf in np.unique(page):
                own = alive[page == leaf]
                to_route = self._apart(asks[own], self.routes[[leaf]])[:, 0]
                computed += len(own)
                limit = tau[own] + slack[own]
                stays = to_route - self.radii[leaf] <= limit
                own, to_route, limit = own[stays], to_route[stays], limit[stays]
                wanted = np.abs(to_route[:, None] - self.stored[leaf]) <= limit[:, None]
                cols = np.flatnonzero(wanted.any(axis=0))
                if not len(cols):
                    continue
                computed += len(own) * len(cols)
                points = self.leaves[leaf][cols]
                score = np.hstack([best[own], queries[own] @ self.points[points, :-1].T])
                ids = np.hstack([best_id[own], np.broadcast_to(least[points], (len(own), len(points)))])
                at = np.hstack([place[own], np.broadcast_to(points, (len(own), len(points)))])
                keep = np.lexsort((ids, -score), axis=1)[:, :k]
                best[own], best_id[own], place[own] = (np.take_along_axis(x, keep, 1) for x in (score, ids, at))
                tau[own] = np.sqrt(np.maximum(0, squares[own] - 2 * best[own, -1]))
        return place, computed

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if np.abs(queries).max(initial=0) * np.abs(self.matrix).max(initial=0) * self.matrix.shape[1] < 2.0**53:
            places, _ = self.nearest(queries, k + 1)  # one may be the query itself
        else:  # products that doubles cannot hold: every point, in exact integers
            places = np.broadcast_to(np.arange(len(self.points)), (len(queries), len(self.points)))
        for ask, vector, own in zip(ids, queries, places):
            rows = np.concatenate([self.members[p][: k + 1] for p in own if p >= 0])
            rows = rows[self.ids[rows] != ask]
            score = products(vector, self.matrix[rows])
            order = np.lexsort((self.ids[rows], ~score))[:k]  # ~ falls with the score and cannot overflow
            yield np.full(len(order), ask), self.ids[rows][order], score[order]


def top_products(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of floor(scale * x) of each row that `is_query` names."""
    rows = vectors.usable(df, id_col, vector_col, zero_ok=True)
    floored = lambda m: np.floor(np.clip(m * scale, -1e150, 1e150))  # noqa: E731  keeps squares finite
    return vectors.search(rows, is_query, k, MTree, lambda tree, ids, m: tree.search(ids, m, k), "long", floored)
