"""A hierarchical navigable small-world graph over unit vectors, built and searched in batches.

Points come in falling order of their random level, so the nodes of level l are
the first ones and every level is a table of links with one row a node. Many
points are inserted, and many queries walk, at once: a step widens all their
beams together. Points of a batch also see each other.

Near copies share a node. A point within half the link angle of a node joins its
ball instead of the graph; two points of a ball are then within the link angle,
so a ball is linked throughout, however many copies it holds. A search for
links looks for nodes up to one and a half link angles away and widens its beam
until the last node in it lies farther out.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np

# Links of a node above level 0 and at level 0, and the beam of an insertion.
DEGREE, DEGREE_0, BUILD_BEAM = 16, 32, 64
# Points inserted at once, queries that walk at once, nodes that a beam opens in a step.
INSERT, WALK, OPEN = 256, 256, 4
# Pairs of a query and a point that are measured at once.
PAIRS = 1 << 16
# Beams are kept in single precision; what they find is measured in double precision.
SINGLE = 1e-5


def spread(rows: np.ndarray) -> np.ndarray:
    """A number in (0, 1] for every row number, by a 64-bit mixing function."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 1) / float(1 << 53)


def pair_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def beam(vectors: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray,
         size: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, cosines) of the best ``size`` nodes that each query reaches, best first; -1 is none."""
    n = len(q)
    nodes = np.full((n, size), -1, np.int32)
    near = np.full((n, size), -np.inf, np.float32)
    shut = np.ones((n, size), bool)
    seen = np.zeros((n, len(links)), bool)
    nodes[:, 0], near[:, 0], shut[:, 0] = entry, pair_dots(q, vectors[entry]), False
    seen[np.arange(n), entry] = True
    walking = np.arange(n)
    opened = min(OPEN, size)
    while True:
        walking = walking[~shut[walking].all(axis=1)]
        if not len(walking):
            return nodes, near
        # The beam is sorted, so the first open places are the best ones.
        place = np.argsort(shut[walking], axis=1, kind="stable")[:, :opened]
        at = walking[:, None]
        fresh, real = nodes[at, place], ~shut[at, place]
        shut[at, place] = True
        steps = []
        for i in range(opened):
            found = np.where(real[:, i, None], links[fresh[:, i]], -1)
            new = (found >= 0) & ~seen[at, found]
            row, column = np.nonzero(new)
            seen[walking[row], found[row, column]] = True
            steps.append(np.where(new, found, -1))
        found = np.hstack(steps)
        row, column = np.nonzero(found >= 0)
        cosine = np.full(found.shape, -np.inf, np.float32)
        cosine[row, column] = pair_dots(q[walking[row]], vectors[found[row, column]])
        all_near = np.hstack([near[walking], cosine])
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :size]
        near[walking] = np.take_along_axis(all_near, order, axis=1)
        nodes[walking] = np.take_along_axis(np.hstack([nodes[walking], found]), order, axis=1)
        shut[walking] = np.take_along_axis(
            np.hstack([shut[walking], found < 0]), order, axis=1) | (nodes[walking] < 0)


def diverse(vectors: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's nodes: those nearer to the row's point than to any node
    chosen before, then the nearest others; -1 fills up."""
    order = np.argsort(-near, axis=1, kind="stable")[:, :max(most, BUILD_BEAM)]
    nodes, near = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(near, order, axis=1)
    kept = np.zeros(nodes.shape, bool)
    real = np.isfinite(near)
    for lo in range(0, len(nodes), 512):
        part = slice(lo, lo + 512)
        own = vectors[nodes[part]]
        among = own @ own.transpose(0, 2, 1)
        count = np.zeros(len(own), int)
        for c in range(nodes.shape[1]):
            crowded = (kept[part] & (among[:, c] > near[part, c, None])).any(axis=1)
            good = real[part, c] & ~crowded & (count < most)
            kept[part, c] = good
            count += good
    order = np.argsort(np.where(kept, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
    chosen = np.where(np.take_along_axis(real, order, axis=1),
                      np.take_along_axis(nodes, order, axis=1), -1)
    if chosen.shape[1] < most:
        chosen = np.pad(chosen, ((0, 0), (0, most - chosen.shape[1])), constant_values=-1)
    return chosen.astype(np.int32)


@dataclass
class Graph:
    """``rows`` and ``points`` (unit, double) by ball; ball i is ``starts[i]:starts[i + 1]`` and
    its first point is node i. ``links[l]`` has a row for each node of level l."""
    rows: np.ndarray
    points: np.ndarray
    starts: np.ndarray
    links: list[np.ndarray]

    @property
    def heads(self) -> np.ndarray:
        return self.starts[:-1]

    def single(self) -> np.ndarray:
        """The nodes in single precision."""
        if not hasattr(self, "_single"):
            self._single = self.points[self.heads].astype(np.float32)
        return self._single

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, rows=self.rows, points=self.points, starts=self.starts,
                 **{f"links{i}": x for i, x in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as x:
            links = [x[f"links{i}"] for i in range(len(x.files) - 3)]
            return cls(x["rows"], x["points"], x["starts"], links)

    def nodes_near(self, q: np.ndarray, bar: float, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a cosine of about ``bar`` or more.

        Beams start at ``size`` and double while their last node is still within
        the bar; a beam of a quarter of the graph gives way to all nodes.
        """
        vectors = self.single()
        single = q.astype(np.float32)
        todo = np.arange(len(q))
        entry = np.zeros(len(q), np.int32)
        for links in self.links[:0:-1]:
            entry = beam(vectors[:len(links)], links, single, entry, 1)[0][:, 0]
        out = []
        while len(todo):
            if 4 * size >= len(vectors):
                near = single[todo] @ vectors.T
                nodes = np.broadcast_to(np.arange(len(vectors)), near.shape)
                more = np.zeros(len(todo), bool)
            else:
                nodes, near = beam(vectors, self.links[0], single[todo], entry[todo], size)
                more = near[:, -1] >= bar - SINGLE
            row, place = np.nonzero((near >= bar - SINGLE) & ~more[:, None])
            out.append((todo[row], nodes[row, place]))
            todo, size = todo[more], 2 * size
        return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]))

    def linked(self, q: np.ndarray, threshold: float, size: int, every: bool):
        """(query, point number) pairs with a cosine of at least ``threshold``, measured.

        One pair for each ball that holds a link, which is what components need,
        or ``every`` pair.
        """
        angle = math.acos(threshold)
        for lo in range(0, len(q), WALK):
            part = q[lo:lo + WALK]
            who, node = self.nodes_near(part, math.cos(1.5 * angle), size)
            head = self.heads[node]
            direct = pair_dots(part[who], self.points[head]) >= threshold
            yield who[direct] + lo, head[direct]
            # The other points of the balls: all, or those of balls whose node is no link.
            rest = np.diff(self.starts)[node] - 1
            if not every:
                rest[direct] = 0
            some = rest > 0
            who, head, rest = who[some], head[some], rest[some]
            ends = np.cumsum(rest)
            for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                pair = np.arange(at, min(at + PAIRS, int(ends[-1])))
                ball = np.searchsorted(ends, pair, side="right")
                point = head[ball] + 1 + pair - (ends[ball] - rest[ball])
                good = pair_dots(part[who[ball]], self.points[point]) >= threshold
                a, b, ball = who[ball[good]], point[good], ball[good]
                if not every:
                    _, first = np.unique(ball, return_index=True)
                    a, b = a[first], b[first]
                yield a + lo, b


def build(rows: np.ndarray, points: np.ndarray, threshold: float) -> Graph:
    """The graph of unit vectors; ``rows`` are their distinct numbers."""
    within = math.cos(math.acos(threshold) / 2) + 1e-12
    chance = spread(rows)
    level = np.floor(-np.log(chance) / math.log(DEGREE)).astype(int)
    order = np.lexsort((chance, -level))
    rows, points, level = rows[order], points[order], level[order]
    total = len(rows)
    top = int(level[0])
    links = [np.full((int((level >= at).sum()), DEGREE if at else DEGREE_0), -1, np.int32)
             for at in range(top + 1)]
    count = [0] * (top + 1)                       # nodes of every level so far
    vectors = np.zeros(points.shape, np.float32)  # of nodes, in order
    ball = np.full(total, -1)                     # the node that a point belongs to
    head: list[int] = []                          # the point that a node is
    at = 0
    while at < total:
        batch = np.arange(at, min(total, at + max(16, min(INSERT, len(head) // 4))))
        at = batch[-1] + 1
        single = points[batch].astype(np.float32)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if head:
            entry = np.zeros(len(batch), np.int32)
            for l in range(top, -1, -1):
                if not count[l]:
                    continue
                size = BUILD_BEAM if l <= level[batch[0]] else 1
                found[l] = beam(vectors[:count[l]], links[l][:count[l]], single, entry, size)
                entry = found[l][0][:, 0]
        own = points[batch] @ points[batch].T
        nodes = _settle(batch, points, own, found.get(0), head, ball, within)
        if not len(nodes):
            continue
        number = np.arange(len(head) - len(nodes), len(head), dtype=np.int32)
        vectors[number] = single[nodes]
        for l in range(min(top, int(level[batch[nodes[0]]])), -1, -1):
            here = nodes[level[batch[nodes]] >= l]
            new = number[:len(here)]
            near = own[np.ix_(here, here)].astype(np.float32)
            np.fill_diagonal(near, -np.inf)
            beside = np.broadcast_to(new, near.shape)
            if l in found:
                beside = np.hstack([found[l][0][here], beside])
                near = np.hstack([found[l][1][here], near])
            count[l] += len(here)
            links[l][new, :DEGREE] = diverse(vectors, beside, near, DEGREE)
            _link_back(vectors, links[l], new)
    order = np.lexsort((np.arange(total) != np.array(head)[ball], ball))
    starts = np.concatenate([[0], np.cumsum(np.bincount(ball, minlength=len(head)))])
    return Graph(rows[order], points[order], starts,
                 [x[:n] for x, n in zip(links, count) if n])


def _settle(batch, points, own, found, head: list[int], ball, within: float) -> np.ndarray:
    """Put each point of a batch into a ball, or make it a node; returns the places of new nodes."""
    known = np.full(len(batch), -1)
    if found is not None:
        known = found[0][:, 0].astype(int)
        close = pair_dots(points[batch], points[np.array(head)[known]]) >= within
        known[~close] = -1
    new: list[int] = []
    for i in range(len(batch)):
        if known[i] < 0 and new:
            j = int(own[i, new].argmax())
            if own[i, new[j]] >= within:
                known[i] = ball[batch[new[j]]]
        if known[i] < 0:
            new.append(i)
            known[i] = len(head)
            head.append(int(batch[i]))
        ball[batch[i]] = known[i]
    return np.array(new, int)


def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Every node that a new one links to links back, and keeps the most diverse if it is full."""
    row, place = np.nonzero(links[new] >= 0)
    source, target = new[row], links[new[row], place]
    known = (links[target] == source[:, None]).any(axis=1)
    source, target = source[~known], target[~known]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, times = np.unique(target, return_index=True, return_counts=True)
    if not len(nodes):
        return
    added = np.full((len(nodes), int(times.max())), -1, np.int32)
    owner = np.repeat(np.arange(len(nodes)), times)
    added[owner, np.arange(len(target)) - first[owner]] = source
    both = np.hstack([links[nodes], added])
    # Free places first; rows that have too few of them are chosen anew.
    both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
    most = links.shape[1]
    full = (both >= 0).sum(axis=1) > most
    links[nodes[~full]] = both[~full, :most]
    for lo in range(0, int(full.sum()), 1024):
        some = np.flatnonzero(full)[lo:lo + 1024]
        beside = both[some]
        near = np.einsum("nd,ncd->nc", vectors[nodes[some]], vectors[beside])
        links[nodes[some]] = diverse(vectors, beside, np.where(beside >= 0, near, -np.inf), most)
