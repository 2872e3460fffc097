"""Density clusters of one tile, by cells in which all points are in each other's reach.

Cells are cubes of a diagonal under eps, so a cell of min_samples points has core
points only and all cores of a cell are of one cluster. What is left to test are
points of sparser cells, one core pair for each two cells that nothing else joins,
and the cores about a point that is none itself.
"""

from __future__ import annotations

import itertools
import math

import numpy as np

from terracell.plans.forest import Forest
from terracell.plans.search import PAIRS, distance2, spread

#: Cells that anything within eps of a cell may lie in, to each side; and the halo that makes cores known so far out.
REACH, HALO = 2, 4
#: Core points of a cell that are tried against its neighbours' first; where none is near, all of them are.
TRIED = 4


def cell_edge(eps: float, d: int) -> float:
    return eps / math.sqrt(d) * (1 - 1e-6)


class Cells:
    """Points by cell; ``next(o)`` has each cell's neighbour at an offset, -1 where it is empty."""

    def __init__(self, units: np.ndarray):
        units = units - units.min(0) + REACH
        dims = units.max(0) + 1 + REACH
        self.stride = np.cumprod(np.concatenate([dims[1:], [1]])[::-1])[::-1].astype(np.int64)
        key = units @ self.stride
        self.order = np.argsort(key, kind="stable")
        self.keys, self.first, self.count = np.unique(key[self.order], return_index=True, return_counts=True)
        self.of = np.repeat(np.arange(len(self.keys)), self.count)
        near = itertools.product(range(-REACH, REACH + 1), repeat=units.shape[1])
        self.offsets = sorted(near, key=lambda o: sum(x * x for x in o))[1:]

    def next(self, o: tuple) -> np.ndarray:
        want = self.keys + int(np.array(o) @ self.stride)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, at, -1)


def _blocks(sizes: np.ndarray):
    """Slices of rows whose sizes add up to PAIRS or, for a larger one, the row alone."""
    total, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        yield slice(i, j)
        i = j


def _hits(p: np.ndarray, points: np.ndarray, others: np.ndarray, first: np.ndarray, count: np.ndarray, limit2: float) -> np.ndarray:
    """For each point, how many of its run of others are within the limit."""
    out = np.zeros(len(points), np.int64)
    for s in _blocks(count):
        which, place = spread(count[s])
        d2 = distance2(p[others[first[s][which] + place]], p[points[s]][which])
        out[s] = np.bincount(which[d2 <= limit2], minlength=s.stop - s.start)
    return out


def _linked(p: np.ndarray, cores: np.ndarray, first: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray, limit2: float, most: int | None) -> np.ndarray:
    """Whether some core of cell a and some of cell b are within the limit; only ``most`` of each are tried, where given."""
    na, nb = (count[x] if most is None else np.minimum(count[x], most) for x in (a, b))
    which, place = spread(na)
    # A cell's cores one by one against the other cell's run.
    hits = _hits(p, cores[first[a][which] + place], cores, first[b][which], nb[which], limit2) > 0
    return np.bincount(which[hits], minlength=len(a)) > 0


def clusters(pid: np.ndarray, p: np.ndarray, units: np.ndarray, own_units, eps: float, min_samples: int):
    """(points, edges): points (pid, node or -1, border) of the tile's own points, and edges (node, node) that join its clusters to other tiles'.

    A node is the least core point's number of a cell, or of all of a tile's cells that are of one cluster.
    ``own_units(units)`` tells the tile's own units.
    """
    c, limit2 = Cells(units), eps * eps
    pid, p, units = pid[c.order], p[c.order], units[c.order]
    cell_units = units[c.first]
    own = own_units(cell_units)
    low, high = cell_units[own].min(0), cell_units[own].max(0)  # the tile's own points lie in this box, which no other's do
    gap = np.maximum(np.maximum(low - cell_units, cell_units - high), 0).max(1)
    known = gap <= REACH
    core = (c.count >= min_samples)[c.of]
    rest = np.flatnonzero(~core & known[c.of])
    n = c.count[c.of[rest]]
    for o in c.offsets:
        if not len(rest):
            break
        to = c.next(o)[c.of[rest]]
        asked = np.flatnonzero(to >= 0)
        n[asked] += _hits(p, rest[asked], np.arange(len(p)), c.first[to[asked]], c.count[to[asked]], limit2)
        core[rest[n >= min_samples]] = True
        rest, n = rest[n < min_samples], n[n < min_samples]
    core &= known[c.of]
    cores = np.flatnonzero(core)
    count = np.bincount(c.of[cores], minlength=len(c.keys))
    first = np.cumsum(count) - count
    forest = Forest(len(c.keys))
    for most in (TRIED, None):
        for o in c.offsets:
            to = c.next(o)
            a = np.flatnonzero((to >= 0) & own & (count > 0))
            b = to[a]
            twice = own[b] & (np.array(o) @ c.stride < 0)  # met from the other side
            a, b = a[~twice & (count[b] > 0)], b[~twice & (count[b] > 0)]
            if most is None:
                a, b = (v[count[a] * count[b] > 0] for v in (a, b))
            roots = forest.roots()
            a, b = (v[roots[a] != roots[b]] for v in (a, b))
            if most is None and len(a):  # one pair of cells for each two trees at a time; the rest may be joined by then
                while len(a):
                    pair = np.stack([np.minimum(roots[a], roots[b]), np.maximum(roots[a], roots[b])], 1)
                    _, one = np.unique(pair, axis=0, return_index=True)
                    hit = _linked(p, cores, first, count, a[one], b[one], limit2, None)
                    forest.union(a[one][hit], b[one][hit])
                    left = np.ones(len(a), bool)
                    left[one] = False
                    roots = forest.roots()
                    a, b = a[left], b[left]
                    a, b = (v[roots[a] != roots[b]] for v in (a, b))
            elif len(a):
                hit = _linked(p, cores, first, count, a, b, limit2, most)
                forest.union(a[hit], b[hit])
    roots = forest.roots()
    top = np.iinfo(np.int64).max
    node = np.full(len(c.keys), top)
    np.minimum.at(node, c.of[cores], pid[cores])
    least = np.full(len(c.keys), top)
    np.minimum.at(least, roots, node)
    least = least[roots]
    inner = (np.minimum(cell_units - low, high - cell_units)).min(1)
    seen = (count > 0) & ((own & (inner < REACH)) | (~own & (np.bincount(roots[own & (count > 0)], minlength=len(roots))[roots] > 0))) & (node != least)
    edges = node[seen], least[seen]
    mine = own[c.of]
    out = [(pid[core & mine], least[c.of[core & mine]], np.zeros(int((core & mine).sum()), bool))]
    asked = np.flatnonzero(mine & ~core)
    pairs = []
    for o in [(0,) * p.shape[1], *c.offsets]:
        to = c.next(o)[c.of[asked]]
        with_cores = (to >= 0) & (np.where(to >= 0, count[to], 0) > 0)
        x, to = asked[with_cores], to[with_cores]
        hit = _hits(p, x, cores, first[to], count[to], limit2) > 0
        pairs.append(np.stack([x[hit], least[to[hit]]], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    out.append((pid[pairs[:, 0]], pairs[:, 1], np.ones(len(pairs), bool)))
    noise = np.setdiff1d(asked, pairs[:, 0])
    out.append((pid[noise], np.full(len(noise), -1), np.zeros(len(noise), bool)))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)), edges
