"""Navigable small-world graphs over the ring of key digests.

Whether two media are the same is equality of their canonical keys, which has no neighbourhood to navigate by. A digest
gives one: keys are points on the ring of 64-bit numbers, linked to both neighbours and to a few nodes at harmonically
spread distances. Greedy routing over such links takes O(log^2 n / links) steps, and ends at the nearest node, since on a
ring with neighbour links no other node is a local minimum. A beam keeps several routes; its width is tuned against
exhaustive search. What routing finds is then compared exactly, over 128 bits.
"""

from __future__ import annotations

import numpy as np

LINKS = 8
FAN_IN = 4  # as many shards of like size are compacted into one


class RingGraph:
    """One shard: nodes in digest order with the id accepted for each, and their links."""

    def __init__(self, h: np.ndarray, g: np.ndarray, ids: np.ndarray, links: np.ndarray | None = None, beam: int = 1):
        self.h, self.g, self.ids, self.beam = h, g, ids, beam
        self.links = _link(len(h)) if links is None else links

    @classmethod
    def build(cls, h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> RingGraph:
        """Of distinct digests in any order."""
        order = np.lexsort((g, h))
        graph = cls(h[order], g[order], ids[order])
        graph.tune()
        return graph

    def to_bytes(self) -> bytes:
        head = np.array([len(self.h), self.links.shape[1], self.beam], "<i8").tobytes()
        return b"".join([head, *(a.tobytes() for a in (self.h, self.g, self.ids, self.links))])

    @classmethod
    def of_bytes(cls, b: bytes) -> RingGraph:
        n, k, beam = map(int, np.frombuffer(b, "<i8", 3))
        h, g, ids = (np.frombuffer(b, kind, n, 24 + 8 * n * i) for i, kind in enumerate(("<u8", "<i8", "<i8")))
        return cls(h, g, ids, np.frombuffer(b, "<i4", n * k, 24 + 24 * n).reshape(n, k), beam)

    def route(self, q: np.ndarray, beam: int | None = None) -> np.ndarray:
        """The node nearest to each of these digests, by greedy routing with a beam."""
        n, w = len(self.h), min(beam or self.beam, len(self.h))
        start = (np.arange(w) * n // w).astype(np.int32)
        best = np.broadcast_to(start, (len(q), w)).copy()
        far = _apart(self.h[best], q[:, None])
        order = np.argsort(far, axis=1, kind="stable")
        best, far = np.take_along_axis(best, order, 1), np.take_along_axis(far, order, 1)
        going = np.arange(len(q))
        while len(going):
            now, was = best[going], far[going]
            next_ = self.links[now].reshape(len(going), -1)
            d = _apart(self.h[next_], q[going, None])
            if w == 1:
                pick = d.argmin(axis=1)[:, None]
                node, dist = np.take_along_axis(next_, pick, 1), np.take_along_axis(d, pick, 1)
            else:
                both, all_d = np.concatenate([now, next_], 1), np.concatenate([was, d], 1)
                o = np.argsort(all_d, axis=1, kind="stable")
                both, all_d = np.take_along_axis(both, o, 1), np.take_along_axis(all_d, o, 1)
                repeated = np.zeros(both.shape, bool)
                repeated[:, 1:] = all_d[:, 1:] == all_d[:, :-1]  # the same node again lies together
                o = np.argsort(repeated, axis=1, kind="stable")[:, :w]
                node, dist = np.take_along_axis(both, o, 1), np.take_along_axis(all_d, o, 1)
            better = dist[:, 0] < was[:, 0]
            best[going[better]], far[going[better]] = node[better], dist[better]
            going = going[better]
        return best[:, 0]

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The id accepted for each digest, or -1: the routed node and its neighbours are compared over all bits."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.h) or not len(h):
            return out
        at = self.route(h)
        for shift in (0, -1, 1):
            near = (at + shift) % len(self.h)
            same = (self.h[near] == h) & (self.g[near] == g)
            out[same] = self.ids[near[same]]
        return out

    def tune(self, sample: int = 64, widest: int = 16) -> None:
        """Widen the beam until routing agrees with exhaustive search on a sample of the digests between nodes."""
        if len(self.h) < 2:
            return
        picks = np.linspace(0, len(self.h) - 2, min(sample, len(self.h) - 1)).astype(int)
        with np.errstate(over="ignore"):
            q = self.h[picks] + ((self.h[picks + 1] - self.h[picks]) // np.uint64(3))
        nearest = np.array([_apart(self.h, x).min() for x in q])
        self.beam = 1
        while self.beam < widest and (_apart(self.h[self.route(q)], q) != nearest).any():
            self.beam *= 2


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        d = a - b
        return np.minimum(d, np.uint64(0) - d)


def _link(n: int) -> np.ndarray:
    """Per node both neighbours and LINKS nodes at distances n**u of either side, u uniform: harmonic in distance."""
    rng = np.random.default_rng(n)
    hop = np.maximum(1, np.exp(rng.random((n, LINKS)) * np.log(max(n, 2))) / 2).astype(np.int64)
    hop *= rng.choice(np.array([-1, 1]), (n, LINKS))
    hop = np.concatenate([np.full((n, 1), -1), np.full((n, 1), 1), hop], axis=1)
    return ((np.arange(n)[:, None] + hop) % max(n, 1)).astype(np.int32)


class Shards:
    """The history of one part of the keys: a graph per batch, compacted on a schedule. A shard covers a span of batches."""

    def __init__(self) -> None:
        self.graphs: list[RingGraph] = []
        self.spans: list[tuple[int, int]] = []

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        first = np.full(len(h), -1, np.int64)
        for graph in self.graphs:
            open_ = np.flatnonzero(first < 0)
            if not len(open_):
                break
            first[open_] = graph.find(h[open_], g[open_])
        return first

    def accept(self, h: np.ndarray, g: np.ndarray, ids: np.ndarray, batch: int = 0) -> np.ndarray:
        """A batch of distinct digests: the id accepted before for each, or -1 for those that it accepts now."""
        first = self.find(h, g)
        new = first < 0
        if new.any():
            self.graphs.append(RingGraph.build(h[new], g[new], ids[new]))
            self.spans.append((batch, batch))
            self.compact()
        return first

    def compact(self) -> None:
        """The last FAN_IN shards become one as soon as the oldest of them isn't much larger than the rest."""
        while len(self.graphs) >= FAN_IN and len(self.graphs[-FAN_IN].h) < FAN_IN * sum(len(x.h) for x in self.graphs[1 - FAN_IN :]):
            last = self.graphs[-FAN_IN:]
            self.graphs[-FAN_IN:] = [RingGraph.build(*(np.concatenate([getattr(x, c) for x in last]) for c in ("h", "g", "ids")))]
            self.spans[-FAN_IN:] = [(self.spans[-FAN_IN][0], self.spans[-1][1])]
