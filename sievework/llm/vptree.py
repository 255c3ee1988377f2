"""Exact Hamming-distance search over 64-bit fingerprints with vantage-point trees in numpy."""

from __future__ import annotations

import numpy as np

LEAF = 128
#: Vantage points tried for a cut, and the points that a trial looks at.
TRIES, TRIAL = 8, 2048
#: A ball of so many points around a probe is merged at once.
DENSE, PROBES = 512, 48
CHUNK = 2048


def distance(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


class Tree:
    """Points, of which the bits in mask count, halved again and again by their distance from a vantage point.

    An inner node is (vantage point, cut, near child, far child); near are those at a distance of cut or less.
    Of a few vantage points the one is taken whose cut leaves the fewest points within radius of both sides.
    """

    def __init__(self, points: np.ndarray, mask: int = (1 << 64) - 1, radius: int = 1, leaf: int = LEAF, seed: int = 0):
        self.mask, self.radius = np.uint64(mask), radius
        self.nodes: list[tuple | None] = []
        self.members: list[np.ndarray] = []
        self.leaf_of: list[int] = []
        own = points & self.mask
        rng = np.random.default_rng(seed)
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            who, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                vantage, cut, *below = self.nodes[parent]
                below[side] = at
                self.nodes[parent] = (vantage, cut, *below)
            found = self._cut(own[who], rng) if len(who) > leaf else None
            if found is None:
                self.nodes.append(None)
                self.leaf_of.append(len(self.members))
                self.members.append(who)
                continue
            vantage, cut = found
            self.nodes.append((vantage, cut, -1, -1))
            self.leaf_of.append(-1)
            near = distance(own[who], vantage) <= cut
            todo += [(who[~near], at, 1), (who[near], at, 0)]

    def _cut(self, own: np.ndarray, rng) -> tuple[np.uint64, int] | None:
        """The best vantage point and cut of a few, None if the points cannot be told apart."""
        seen = own if len(own) <= TRIAL else own[rng.integers(0, len(own), TRIAL)]
        best = None
        for v in own[rng.integers(0, len(own), TRIES)]:
            away = distance(seen, v)
            middle = int(np.partition(away, len(away) // 2)[len(away) // 2])
            for cut in (middle - 1, middle):
                near = np.count_nonzero(away <= cut) / len(away)
                if 0 < near < 1:
                    both = np.count_nonzero((away > cut - self.radius) & (away <= cut + self.radius)) / len(away)
                    score = both + abs(near - 0.5)
                    if best is None or score < best[0]:
                        best = (score, v, cut)
        return None if best is None else best[1:]

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into."""
        out = np.empty(len(points), np.int64)
        for leaf, who in self.visits(points, -1):
            out[who] = leaf
        return out

    def visits(self, queries: np.ndarray, radius: int | None = None):
        """Yields (leaf, indices of queries) for each leaf that can hold points within radius of a query.

        By the triangle inequality a query at distance d from the vantage point has partners on the near
        side only if d <= cut + radius and on the far side only if d > cut - radius; a query between the
        two bounds visits both sides. Radius -1 follows each point to its one leaf.
        """
        radius = self.radius if radius is None else radius
        over, under = (0, 0) if radius < 0 else (radius, radius)
        todo = [(0, np.arange(len(queries)))]
        own = queries & self.mask
        while todo:
            at, who = todo.pop()
            if not len(who):
                continue
            if self.nodes[at] is None:
                yield self.leaf_of[at], who
                continue
            vantage, cut, near, far = self.nodes[at]
            away = distance(own[who], vantage)
            todo += [(far, who[away > cut - under]), (near, who[away <= cut + over])]


def spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the labels a[i] and b[i] have been made one; the least label of a set stays."""
    up = np.arange(len(label))
    while True:
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        if np.array_equal(low, high):
            break
        np.minimum.at(up, high, low)
        while not np.array_equal(up, up[up]):
            up = up[up]
    return up[label]


class Shard:
    """Distinct points of a shard with their components, and a tree that finds what is within reach of a query.

    Links are pairs within `radius` over all bits that are within `near` over the tree's bits. All pairs of
    a dense group are never listed: points within radius of a probe belong to one component, so a ball is
    merged at the cost of its size, and later only points of different components are compared.
    """

    def __init__(self, points: np.ndarray, radius: int, mask: int = (1 << 64) - 1, near: int | None = None):
        self.points, self.radius = points, radius
        self.label = np.arange(len(points))
        self.centres: list[int] = []
        self._balls()
        self.tree = Tree(points, mask, radius if near is None else near)
        for a in range(0, len(points), CHUNK):
            mine = np.arange(a, min(a + CHUNK, len(points)))
            found = self._meet(points[mine], self.label[mine])
            if len(found):
                self.label = spread(self.label, self.label[mine[found[:, 0]]], found[:, 1])

    def _balls(self) -> None:
        rng, alone, found = np.random.default_rng(len(self.points)), np.ones(len(self.points), bool), True
        while found and np.count_nonzero(alone) >= DENSE:
            found = False
            left = np.flatnonzero(alone)
            for i in rng.choice(left, min(len(left), PROBES), replace=False).tolist():
                if alone[i]:
                    ball = np.flatnonzero(distance(self.points, self.points[i]) <= self.radius)
                    if len(ball) >= DENSE:
                        self.label = spread(self.label, self.label[ball], np.full(len(ball), self.label[ball].min()))
                        alone[ball] = False
                        self.centres.append(i)
                        found = True

    def _meet(self, queries: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Rows (query, label) of links to components other than the one known of the query, -1 for none."""
        out = []
        for leaf, who in self.tree.visits(queries):
            own = self.tree.members[leaf]
            marks, counts = np.unique(self.label[own], return_counts=True) if len(own) > 4 * LEAF else (None, None)
            parts = [(who, own)]
            if marks is not None:  # those of a large leaf's commonest component need not meet it
                most = marks[counts.argmax()]
                same = known[who] == most
                parts = [(who[same], own[self.label[own] != most]), (who[~same], own)]
            for mine, theirs in parts:
                for b in range(0, len(theirs) if len(mine) else 0, 4096):
                    part = theirs[b : b + 4096]
                    q, p = np.nonzero(np.bitwise_count(queries[mine][:, None] ^ self.points[part][None, :]) <= self.radius)
                    if len(q):
                        row, label = mine[q], self.label[part[p]]
                        apart = known[row] != label
                        if apart.any():
                            out.append(np.unique(np.stack([row[apart], label[apart]], 1), axis=0))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def visitors(self, queries: np.ndarray) -> np.ndarray:
        """Rows (query, label), once each, of the components that each query is linked with."""
        known = np.full(len(queries), -1, np.int64)
        for c in self.centres:
            known[(known < 0) & (distance(queries, self.points[c]) <= self.radius)] = c
        inside = np.flatnonzero(known >= 0)
        known[inside] = self.label[known[inside]]
        first = np.stack([inside, known[inside]], 1)
        more = [self._meet(queries[a : a + CHUNK], known[a : a + CHUNK]) + [[a, 0]] for a in range(0, len(queries), CHUNK)]
        return np.unique(np.concatenate([first, *more]), axis=0)


def components(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of distinct points the least index in its component, under links within radius."""
    return Shard(points, radius).label
