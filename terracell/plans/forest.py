"""Union-find over whole arrays of links."""

from __future__ import annotations

import numpy as np


class Forest:
    """Union-find over 0..n-1; roots are least members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root(a), self.root(b)
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self) -> np.ndarray:
        self.parent = self.root(np.arange(len(self.parent)))
        return self.parent


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) of each component that the links make, least members themselves left out."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = Forest(len(ids))
    forest.union(at[: len(u)], at[len(u) :])
    root = forest.roots()
    member = root != np.arange(len(ids))
    return ids[member], ids[root[member]]
