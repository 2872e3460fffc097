"""Searches among the points of one tile, on arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points of a leaf by and large, and pairs that are held at once.
LEAF, PAIRS = 2, 1_000_000


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): for each row so many entries as it counts, numbered from 0 within the row."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _interleaved(v: np.ndarray) -> np.ndarray:
    """Integers of up to 21 bits along three axes, or 31 along two, as one Morton code."""
    out = np.zeros(len(v), np.int64)
    d = v.shape[1]
    for b in range(int(v.max(initial=0)).bit_length()):
        for k in range(d):
            out |= (v[:, k] >> b & 1) << (b * d + k)
    return out


class Tree:
    """Points in Morton order and the boxes around those that share a prefix, level by level."""

    def __init__(self, p: np.ndarray, pid: np.ndarray):
        d = p.shape[1]
        self.low = p.min(0)
        extent = max(float((p.max(0) - self.low).max()), 1e-300)
        self.depth = 16 if d == 3 else 24
        self.step = extent / ((1 << self.depth) - 1)
        code = self.code(p)
        self.order = np.lexsort((pid, code))
        self.p, self.pid, self.codes = p[self.order], pid[self.order], code[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # box low, box high, first child, children
        firsts = []
        for level in range(self.depth + 1):
            prefix = self.codes >> d * (self.depth - level)
            first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            firsts.append(first)
            if len(p) / len(first) <= LEAF or level and len(first) > 64 and len(first) < 1.05 * len(firsts[-2]):
                break
        # Levels that tell nothing apart are left out.
        firsts = [f for k, f in enumerate(firsts) if k == len(firsts) - 1 or len(f) < len(firsts[k + 1])]
        for k, first in enumerate(firsts):
            below = np.searchsorted(firsts[k + 1], first) if k + 1 < len(firsts) else first
            end = len(firsts[k + 1]) if k + 1 < len(firsts) else len(p)
            self.levels.append((np.minimum.reduceat(self.p, first), np.maximum.reduceat(self.p, first), below, np.diff(below, append=end)))

    def code(self, p: np.ndarray) -> np.ndarray:
        at = np.clip(np.floor((p - self.low) / self.step), 0, (1 << self.depth) - 1).astype(np.int64)
        return _interleaved(at)

    def _near(self, q: np.ndarray, limit2: np.ndarray, closest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, d2) of all points within each query's limit or, with ``closest``, of those that may be its nearest; queries ascend."""
        limit2 = limit2.copy()
        which, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        if len(self.levels[0][2]) > 1:
            which, node = spread(np.full(len(q), len(self.levels[0][2])))
        for low, high, below, n in self.levels:
            x = q[which]
            lo, hi = low[node], high[node]
            gap = np.maximum(np.maximum(lo - x, x - hi), 0.0)
            near = np.einsum("ij,ij->i", gap, gap)
            if closest:
                far = np.maximum(np.abs(x - lo), np.abs(x - hi))
                far = np.einsum("ij,ij->i", far, far) * (1 + 1e-12)
                np.minimum.at(limit2, which, far)
            kept = near * (1 - 1e-12) <= limit2[which]
            which, node = which[kept], node[kept]
            again, place = spread(n[node])
            which, node = which[again], below[node][again] + place
        d2 = distance2(self.p[node], q[which])
        kept = d2 <= limit2[which]
        return which[kept], node[kept], d2[kept]

    def _limits(self, q: np.ndarray, k: int, width: int, most2: float) -> np.ndarray:
        """A bound of each query's k-th smallest d2, from the points about its place in Morton order; ``most2`` at most."""
        out = np.full(len(q), most2)
        if len(self.p) < k:
            return out
        width = min(len(self.p), width)
        at = np.clip(np.searchsorted(self.codes, self.code(q)) - width // 2, 0, len(self.p) - width)
        block = max(1, PAIRS // width)
        for i in range(0, len(q), block):
            near = at[i : i + block, None] + np.arange(width)
            d2 = distance2(self.p[near], q[i : i + block, None])
            out[i : i + block] = np.minimum(most2, np.partition(d2, k - 1, axis=1)[:, k - 1] if k > 1 else d2.min(1))
        return out

    def nearest(self, q: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, d2) of each query's nearest point within reach, -1 where none is; ties go to the lowest pid."""
        found, best = np.full(len(q), -1), np.full(len(q), np.inf)
        order = np.argsort(self.code(q), kind="stable")
        step = 20_000
        for i in range(0, len(q), step):
            rows = order[i : i + step]
            limit = self._limits(q[rows], 1, 8, reach * reach)
            which, point, d2 = self._near(q[rows], limit, True)
            if not len(which):
                continue
            first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            least = np.minimum.reduceat(d2, first)
            size = np.diff(first, append=len(which))
            tied = d2 == np.repeat(least, size)
            which, point, d2 = which[tied], point[tied], d2[tied]
            if len(which) > len(first):
                again = np.lexsort((self.pid[point], which))
                which, point, d2 = which[again], point[again], d2[again]
                one = np.concatenate([[True], which[1:] != which[:-1]])
                which, point, d2 = which[one], point[one], d2[one]
            found[rows[which]], best[rows[which]] = point, d2
        return found, best

    def closest(self, q: np.ndarray, k: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, which, point, d2): some of the queries at a time, and the k nearest points of each within reach (ties: lowest pid), pairs by query and rank."""
        order = np.argsort(self.code(q), kind="stable")
        step = max(1, min(5_000, PAIRS // (8 * k)))
        for i in range(0, len(q), step):
            rows = order[i : i + step]
            x = q[rows]
            limit = self._limits(x, k, 3 * k, reach * reach)
            parts, at = [], 0
            while at < len(rows):  # where limits are wide, fewer queries at once
                size = min(step, len(rows) - at)
                which, point, d2 = self._near(x[at : at + size], limit[at : at + size], False)
                parts.append((which + at, point, d2))
                at += size
            which, point, d2 = (np.concatenate(v) for v in zip(*parts, strict=True))
            n = np.bincount(which, minlength=len(rows))
            wide = int(n.max(initial=0))
            if wide > k:
                kth = np.full(len(rows), np.inf)
                many = np.flatnonzero(n > k)
                start = np.cumsum(n) - n
                # Rows of like length together, so that little is padded.
                many = many[np.argsort(n[many], kind="stable")]
                j = 0
                while j < len(many):
                    size = max(1, PAIRS // int(n[many[min(len(many) - 1, j + 255)]]))
                    rows_ = many[j : j + min(size, 256)]
                    w = int(n[rows_].max())
                    place = np.arange(w)
                    here = place < n[rows_, None]
                    d = np.where(here, d2[np.minimum(start[rows_, None] + place, len(d2) - 1)], np.inf)
                    kth[rows_] = np.partition(d, k - 1, axis=1)[:, k - 1]
                    j += len(rows_)
                kept = d2 <= kth[which]
                which, point, d2 = which[kept], point[kept], d2[kept]
            again = np.lexsort((self.pid[point], d2, which))
            which, point, d2 = which[again], point[again], d2[again]
            n = np.bincount(which, minlength=len(rows))
            kept = spread(n)[1] < k
            yield rows, which[kept], point[kept], d2[kept]


def distance2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, added axis by axis as the column form does."""
    d = a[..., 0] - b[..., 0]
    out = d * d
    for k in range(1, a.shape[-1]):
        d = a[..., k] - b[..., k]
        out += d * d
    return out
