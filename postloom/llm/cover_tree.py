"""Cover tree over norm-augmented vectors, for searches by inner product.

A vector x gets one more component, sqrt(M * M - |x| * |x|), M being the largest norm in the
tree, so that all have norm M. With a query q that gets a 0, |q - x| squared is |q|^2 + M^2 -
2 * (q, x), so what covers a node's vectors at radius r around its centre bounds their inner
products from both sides.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

#: Nodes of so many vectors or fewer are leaves.
LEAF = 64
#: A node that would have fewer vectors than this for each child is a leaf, however large: its balls cover nothing.
PER_CHILD = 4
#: After so many centres it is seen whether they cover enough to go on.
TRIED = 32
#: Rows of a leaf that are multiplied at once.
SLAB = 8_192


@dataclass
class Tree:
    """Vectors in the tree's order; node k covers rows begin[k]..end[k], and its children are the nodes child[k]..child[k + 1]."""

    vectors: np.ndarray
    norm: float
    centres: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    children: list[tuple[int, int]]
    order: np.ndarray

    def bounds(self, queries: np.ndarray, norms: np.ndarray, nodes: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with a node's vectors; a unit wider than reckoned, for rounding."""
        return ball_bounds(queries, norms, self.centres[nodes], self.radius[nodes], self.norm)


def augmented(vectors: np.ndarray, norm: float) -> np.ndarray:
    """With the component that brings each vector to the norm; those that are longer get a 0."""
    rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors), 0.0))
    return np.column_stack((vectors, rest))


def centres_for(centres: np.ndarray, width: int) -> np.ndarray:
    """Augmented centres with zeros before the last component, for vectors of that width."""
    more = max(0, width + 1 - centres.shape[1])
    return np.concatenate((centres[:, :-1], np.zeros((len(centres), more)), centres[:, -1:]), axis=1)


def ball_bounds(queries: np.ndarray, norms: np.ndarray, centres: np.ndarray, radius: np.ndarray, norm: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) inner products of queries with vectors of `norm` when augmented that lie within the radius of augmented centres."""
    along = queries @ centres[:, :-1].T
    squares = norms[:, None] ** 2 + np.square(norm)
    # a centre is a mean, so it may lie inside the sphere of its vectors
    away = np.sqrt(np.maximum(norms[:, None] ** 2 + np.einsum("ij,ij->i", centres, centres) - 2 * along, 0.0))
    reach = norms[:, None] * radius
    high = np.minimum((squares - np.maximum(away - radius, 0.0) ** 2) / 2, along + reach)
    low = np.maximum((squares - (away + radius) ** 2) / 2, along - reach)
    slack = 1.0 + 1e-9 * squares
    return low - slack, high + slack


def net(points: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres more than `radius` apart that cover all points, each taken farthest from those before; and the nearest one's number for each point. None if there are more than `most`."""
    chosen = [0]
    away = np.linalg.norm(points - points[0], axis=1)
    nearest = np.zeros(len(points), np.int64)
    while away.max() > radius:
        if len(chosen) == most or len(chosen) == TRIED and (away <= radius).sum() < PER_CHILD * TRIED:
            return None
        k = int(away.argmax())
        d = np.linalg.norm(points - points[k], axis=1)
        closer = d < away
        nearest[closer] = len(chosen)
        away = np.minimum(away, d)
        chosen.append(k)
    return np.array(chosen), nearest


def build(vectors: np.ndarray) -> Tree:
    """Levels halve the radius: a node's children are a net of half its covering radius. vectors: whole numbers as float64."""
    norm = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0)))
    points = augmented(vectors, norm)
    order = np.arange(len(points))
    centres, radius, begin, end, children = [], [], [], [], []

    def node(lo: int, hi: int) -> int:
        mine = points[order[lo:hi]]
        middle = mine.mean(axis=0)
        centres.append(middle)
        radius.append(float(np.linalg.norm(mine - middle, axis=1).max()))
        begin.append(lo)
        end.append(hi)
        children.append((0, 0))
        return len(centres) - 1

    todo = [node(0, len(points))] if len(points) else []
    while todo:
        k = todo.pop()
        lo, hi = begin[k], end[k]
        if hi - lo <= LEAF or radius[k] == 0:
            continue
        found = net(points[order[lo:hi]], radius[k] / 2, max(2, min((hi - lo) // PER_CHILD, 1_024)))
        if found is None:
            continue
        by = np.argsort(found[1], kind="stable")
        order[lo:hi] = order[lo:hi][by]
        cuts = lo + np.searchsorted(found[1][by], np.arange(len(found[0]) + 1))
        first = len(centres)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            node(a, b)
        children[k] = (first, len(centres))
        todo.extend(range(first, len(centres)))
    width = points.shape[1]
    return Tree(vectors[order], norm, np.array(centres).reshape(-1, width), np.array(radius), np.array(begin, np.int64), np.array(end, np.int64), children, order)


def kind_for(most: float) -> type:
    """The leanest type in which sums of products up to `most` are exact; beyond 2 ** 53 whole numbers, as far as 64 bits reach."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


@dataclass
class Asked:
    """Queries: vectors, a window of scores each, and the greatest scores found so far, at most k."""

    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    best: list[list[tuple[int, int]]] = field(default_factory=list)

    def __post_init__(self):
        self.best = self.best or [[] for _ in self.low]

    def floor(self, q: int) -> float:
        """What a score has to reach: the window's end, or the k-th best. Equal scores may still win by their id."""
        held = self.best[q]
        return max(float(self.low[q]), -held[-1][0]) if len(held) == self.k else float(self.low[q])

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Keep the best of those held and these: greatest scores, then least ids."""
        if len(scores) > 4 * self.k:
            enough = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[enough], ids[enough]
        self.best[q] = heapq.nsmallest(self.k, [*self.best[q], *zip((-scores).tolist(), ids.tolist(), strict=True)])


def search(tree: Tree, asked: Asked, fits) -> None:
    """Best-first descent for all queries at once, exact.

    In each round every query takes its open node of the greatest bound; nodes outside its window or
    below its floor are never opened. A leaf's rows are verified by their exact scores.
    fits(q, rows, scores) gives the (scores, ids) of rows that count for query q.
    """
    if not len(tree.order) or not len(asked.low):
        return
    queries = asked.vectors.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    kind = kind_for(float(norms.max(initial=0.0)) * tree.norm)
    rows, exact = tree.vectors.astype(kind), asked.vectors.astype(kind)
    frontier: list[list[tuple[float, int]]] = [[] for _ in norms]

    def open_children(qs: np.ndarray, nodes: slice) -> None:
        low, high = tree.bounds(queries[qs], norms[qs], nodes)
        for q, lows, highs in zip(qs.tolist(), low, high, strict=True):
            inside = np.flatnonzero((highs >= asked.floor(q)) & (lows <= asked.high[q]))
            for n in inside.tolist():
                heapq.heappush(frontier[q], (-float(highs[n]), nodes.start + n))

    def verify(qs: np.ndarray, node: int) -> None:
        for lo in range(int(tree.begin[node]), int(tree.end[node]), SLAB):
            hi = min(lo + SLAB, int(tree.end[node]))
            scores = exact[qs] @ rows[lo:hi].T
            for q, mine in zip(qs.tolist(), scores, strict=True):
                at = np.flatnonzero((mine >= asked.floor(q)) & (mine <= asked.high[q]))
                if len(at):
                    asked.offer(q, *fits(q, lo + at, mine[at].astype(np.int64)))

    open_children(np.arange(len(norms)), slice(0, 1))
    live = range(len(norms))
    while live:
        turn: dict[int, list[int]] = {}
        for q in live:
            if frontier[q] and -frontier[q][0][0] >= asked.floor(q):
                turn.setdefault(heapq.heappop(frontier[q])[1], []).append(q)
        for node, qs in turn.items():
            a, b = tree.children[node]
            open_children(np.array(qs), slice(a, b)) if a < b else verify(np.array(qs), node)
        live = [q for qs in turn.values() for q in qs]
