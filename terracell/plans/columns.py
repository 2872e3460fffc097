"""Moments of balls and cylinders around the points of one tile, on arrays.

A tile's points lie in small boxes along Morton order, whose moments are added up
once. Queries are answered in blocks: boxes that lie wholly inside count by their
moments, those wholly outside not at all, and only the points of the rest are
tested one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from terracell.plans.search import Tree, distance2, spread

#: Queries of a block; points of a box and of a group of boxes; pairs that are held at once.
BLOCK, BOX, GROUP, HELD = 64, 24, 320, 1 << 15
#: What a pair costs that is tested by itself, in pairs of a table of all.
ALONE = 16
#: Bounds are widened and narrowed by this much, so that rounding never decides for a whole box.
SLACK = 1e-9


class _Boxes:
    """Runs of points in Morton order: first point, number, and the box around them."""

    def __init__(self, p: np.ndarray, first: np.ndarray):
        self.first, self.n = first, np.diff(first, append=len(p))
        self.low, self.high = np.minimum.reduceat(p, first), np.maximum.reduceat(p, first)
        self.centre = (self.low + self.high) / 2
        self.half = np.sqrt(((self.high - self.low) ** 2).sum(1)) / 2 + SLACK


class Columns:
    def __init__(self, p: np.ndarray, pid: np.ndarray):
        self.tree = Tree(p, pid)
        self.p, self.origin = self.tree.p, p.mean(0)
        c = self.p - self.origin
        self.features = np.column_stack([np.ones(len(c)), c, c[:, [0, 0, 0, 1, 1, 2]] * c[:, [0, 1, 2, 1, 2, 2]]])
        # A box is the largest prefix of a Morton code with few enough points, or a part of a place with more.
        self.boxes = _Boxes(self.p, self._runs(BOX))
        # Groups begin where boxes do.
        self.groups = _Boxes(self.p, np.unique(self.boxes.first[np.searchsorted(self.boxes.first, self._runs(GROUP), "right") - 1]))
        self.sums = np.add.reduceat(self.features, self.boxes.first)
        self.of_group = np.searchsorted(self.boxes.first, self.groups.first)
        self.in_group = np.diff(self.of_group, append=len(self.boxes.first))

    def _runs(self, most: int) -> np.ndarray:
        codes, d, n = self.tree.codes, self.p.shape[1], len(self.p)
        cut = np.zeros(n, bool)
        cut[::most] = True
        done = np.zeros(n, bool)
        for level in range(self.tree.depth + 1):
            prefix = codes >> d * (self.tree.depth - level)
            first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            size = np.diff(first, append=n)
            small = (size <= most) & ~done[first]
            cut[first[small]] = True
            inner = np.repeat(small, size)
            starts = np.zeros(n, bool)
            starts[first] = True
            cut[inner & ~starts] = False
            done |= inner
            if done.all():
                break
        cut[first[~done[first]]] = True
        return np.flatnonzero(cut)

    def _blocks(self, q: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(self.tree.code(q), kind="stable")
        for i in range(0, len(q), BLOCK):
            yield order[i : i + BLOCK]

    def _near(self, x: np.ndarray, reach: float, boxes: _Boxes, among: np.ndarray | slice) -> np.ndarray:
        gap = np.maximum(np.maximum(x.min(0) - boxes.high[among], boxes.low[among] - x.max(0)), 0.0)
        return np.einsum("ij,ij->i", gap, gap) <= reach * reach * (1 + SLACK)

    def _points(self, which: np.ndarray) -> np.ndarray:
        run, place = spread(self.boxes.n[which])
        return self.boxes.first[which][run] + place

    def _boxes_of(self, groups: np.ndarray) -> np.ndarray:
        run, place = spread(self.in_group[groups])
        return self.of_group[groups][run] + place

    def balls(self, q: np.ndarray, radius: float) -> np.ndarray:
        """(number, sums of offsets x y z, of their products xx xy xz yy yz zz) of the points within the radius of each query."""
        out = np.zeros((len(q), 10))
        for rows in self._blocks(q):
            x = q[rows]
            boxes = self._boxes_of(np.flatnonzero(self._near(x, radius, self.groups, slice(None))))
            boxes = boxes[self._near(x, radius, self.boxes, boxes)]
            far = np.maximum(x.max(0) - self.boxes.low[boxes], self.boxes.high[boxes] - x.min(0))
            whole = np.einsum("ij,ij->i", far, far) <= radius * radius * (1 - SLACK)
            sums = np.repeat(self.sums[boxes[whole]].sum(0, keepdims=True), len(rows), axis=0)
            points = self._points(boxes[~whole])
            step, middle = max(1, HELD // len(rows)), x.mean(0)
            y = x - middle
            left = np.column_stack([-2 * y, np.einsum("ij,ij->i", y, y), np.ones(len(y))])
            for i in range(0, len(points), step):
                some = points[i : i + step]
                p = self.p[some] - middle
                d2 = left @ np.vstack([p.T, np.ones(len(p)), np.einsum("ij,ij->i", p, p)])
                held = d2 <= radius * radius * (1 - SLACK)
                close = d2 <= radius * radius * (1 + SLACK)
                if np.count_nonzero(held) < np.count_nonzero(close):  # what rounding might decide is told as pairs are elsewhere
                    query, point = np.nonzero(close & ~held)
                    held[query, point] = distance2(self.p[some[point]], x[query]) <= radius * radius
                sums += held.astype(float) @ self.features[some]
            c = x - self.origin
            n, s = sums[:, :1], sums[:, 1:4]
            out[rows, :1], out[rows, 1:4] = n, s - n * c
            for k, (a, b) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
                out[rows, 4 + k] = sums[:, 4 + k] - c[:, a] * s[:, b] - c[:, b] * s[:, a] + n[:, 0] * c[:, a] * c[:, b]
        return out

    def cylinders(self, q: np.ndarray, normals: np.ndarray, radius: float, depth: float) -> np.ndarray:
        """(number, sums of places along the normal, of their squares) of the points in each query's cylinder."""
        out = np.zeros((len(q), 3))
        r2, reach = radius * radius, float(np.hypot(radius, depth))
        for rows in self._blocks(q):
            x, m = q[rows], normals[rows]
            groups = np.flatnonzero(self._near(x, reach, self.groups, slice(None)))
            groups = groups[self._touched(x, m, radius, depth, self.groups, groups)[0].any(0)]
            boxes = self._boxes_of(groups)
            touched, inside = self._touched(x, m, radius, depth, self.boxes, boxes)
            some = touched.any(0)
            boxes, touched, inside = boxes[some], touched[:, some], inside[:, some]
            if not len(boxes):
                continue
            edge, size = touched & ~inside, self.boxes.n[boxes]
            whole = inside.all(0)
            if ALONE * (edge.sum(0) @ size) < len(rows) * size[~whole].sum():
                sums = inside.astype(float) @ self.sums[boxes]
                query, box = np.nonzero(edge)
                run, place = spread(size[box])
                query, point = query[run], self.boxes.first[boxes[box]][run] + place
                d = self.p[point] - x[query]
                along = np.einsum("ij,ij->i", d, m[query])
                held = (np.abs(along) <= depth) & (np.einsum("ij,ij->i", d, d) - along * along <= r2)
                query, along = query[held], along[held]
                found = [np.bincount(query, w, minlength=len(rows)) for w in (None, along, along * along)]
            else:
                sums = np.repeat(self.sums[boxes[whole]].sum(0, keepdims=True), len(rows), axis=0)
                points = self._points(boxes[~whole])
                found = [np.zeros(len(rows)) for _ in range(3)]
                middle = x.mean(0)
                y, step = x - middle, max(1, HELD // len(rows))
                left = np.column_stack([-2 * y, np.einsum("ij,ij->i", y, y), np.ones(len(y))])
                turned = np.column_stack([m, -np.einsum("ij,ij->i", m, y)])
                for i in range(0, len(points), step):
                    p = self.p[points[i : i + step]] - middle
                    given = np.vstack([p.T, np.ones(len(p)), np.einsum("ij,ij->i", p, p)])
                    along, off = turned @ given[:4], left @ given
                    square = along * along
                    off -= square
                    held = ((off <= r2) & (square <= depth * depth)).astype(float)
                    found[0] += held.sum(1)
                    found[1] += np.einsum("ij,ij->i", along, held)
                    found[2] += np.einsum("ij,ij->i", square, held)
            c = ((x - self.origin) * m).sum(1)
            n, s = sums[:, 0], (sums[:, 1:4] * m).sum(1)
            products = m[:, [0, 0, 0, 1, 1, 2]] * m[:, [0, 1, 2, 1, 2, 2]] * np.array([1, 2, 2, 1, 2, 1])
            squares = (sums[:, 4:] * products).sum(1)
            out[rows] = np.column_stack([n + found[0], s - n * c + found[1], squares - 2 * c * s + n * c * c + found[2]])
        return out

    @staticmethod
    def _touched(x: np.ndarray, m: np.ndarray, radius: float, depth: float, boxes: _Boxes, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which boxes each cylinder may reach into, and which lie in it wholly, by the balls around them."""
        centre, half = boxes.centre[which], boxes.half[which]
        middle = x.mean(0)
        c, y = centre - middle, x - middle
        along = np.abs(m @ c.T - (m * y).sum(1)[:, None])
        off = (y * y).sum(1)[:, None] + (c * c).sum(1) - 2 * (y @ c.T) - along * along
        inner = np.maximum(radius - half, 0)
        return (along <= depth + half) & (off <= (radius + half) ** 2), (along <= depth - half) & (off <= inner * inner) & (half < radius)
