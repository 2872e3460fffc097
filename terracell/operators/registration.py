"""Registration: ICP, FPFH descriptors, descriptor matching, RANSAC, scan chains."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.errors import RegistrationError, ValidationError
from terracell.frame import PointFrame
from terracell.plans.durable import discard, durable
from terracell.plans.neighbours import nearest_within
from terracell.plans.search import PAIRS, Tree, distance2, spread
from terracell.plans.tiles import Tiling, arrays, by_tile, finite

BINS = 11


@dataclass(frozen=True)
class Registration:
    transform: np.ndarray
    fitness: float
    inlier_rmse: float
    converged: bool
    n_iterations: int

    def table(self, spark: SparkSession) -> DataFrame:
        cells = {f"m{i}{j}": float(self.transform[i, j]) for i in range(4) for j in range(4)}
        return spark.createDataFrame([{**cells, "fitness": self.fitness, "inlier_rmse": self.inlier_rmse, "converged": self.converged, "n_iterations": self.n_iterations}])


def matrix4(transform) -> np.ndarray:
    m = np.eye(4) if transform is None else np.asarray(transform, float)
    if m.shape != (4, 4):
        raise ValidationError("a transform is 4 x 4")
    return m


def transformed(df: DataFrame, transform) -> DataFrame:
    """x, y, z (and normals, turned) under a 4 x 4 transform, as column arithmetic."""
    m = matrix4(transform)

    def row(i: int, names: tuple, shift: float) -> Column:
        return sum((F.col(n) * F.lit(float(m[i, j])) for j, n in list(enumerate(names))[1:]), F.col(names[0]) * F.lit(float(m[i, 0]))) + F.lit(shift)

    new = {c: row(i, ("x", "y", "z"), float(m[i, 3])) for i, c in enumerate("xyz")}
    if {"nx", "ny", "nz"} <= set(df.columns):
        new |= {f"n{c}": row(i, ("nx", "ny", "nz"), 0.0) for i, c in enumerate("xyz")}
    return df.withColumns(new)


def kabsch(h: np.ndarray, source_mean: np.ndarray, target_mean: np.ndarray) -> np.ndarray:
    """The rigid transform of least squares, from the centred cross-moments sum s t^T."""
    u, _, vt = np.linalg.svd(h)
    fix = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
    out = np.eye(4)
    out[:3, :3] = vt.T @ fix @ u.T
    out[:3, 3] = target_mean - out[:3, :3] @ source_mean
    return out


def rodrigues(r: np.ndarray) -> np.ndarray:
    """The rotation by |r| about r."""
    angle = float(np.linalg.norm(r))
    if angle < 1e-15:
        return np.eye(3)
    k = np.array([[0, -r[2], r[1]], [r[2], 0, -r[0]], [-r[1], r[0], 0]]) / angle
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def _pairs(source: DataFrame, target: DataFrame, transform: np.ndarray, reach: float) -> DataFrame:
    return nearest_within(transformed(source, transform), target, reach)


def _centre(target: DataFrame) -> np.ndarray:
    row = target.agg(*(F.avg(c) for c in "xyz")).first()
    return np.array(row, float)


def _moved(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``transformed`` of an array, operation by operation."""
    return np.stack([p[:, 0] * m[i, 0] + p[:, 1] * m[i, 1] + p[:, 2] * m[i, 2] + m[i, 3] for i in range(3)], axis=1)


class _Dealt:
    """Source and target in tiles, a row a tile, dealt for one transform and good for those that move no source point over half the reach from it.

    An iteration reads the rows and shuffles nothing.
    """

    def __init__(self, source: DataFrame, target: DataFrame, box: tuple[np.ndarray, np.ndarray], reach: float, plane: bool):
        names = ["x", "y", "z", *(("nx", "ny", "nz") if plane else ())]
        self.source, self.target = source.where(finite("xyz")), target.where(finite("xyz")).select("pid", *names)
        self.corners = np.array(list(itertools.product(*zip(*box, strict=True))))
        self.reach, self.plane, self.at, self.rows = reach, plane, None, None

    def _deal(self, t: np.ndarray) -> None:
        self.discard()
        placed = transformed(self.source.select("x", "y", "z", *(F.col(c).alias(f"o{c}") for c in "xyz")), t)
        tiling = Tiling.of(placed.select("x", "y", "z").unionAll(self.target.select("x", "y", "z")), "xyz", self.reach * 1.5 * (1 + 1e-9), rows=TILE_POINTS)
        names = self.target.columns
        left = tiling.home(placed).select("tile", F.lit(None).cast("long").alias("pid"), *(F.col(f"o{c}").alias(c) for c in "xyz"), *(F.lit(None).cast("double").alias(c) for c in names[4:]))
        right = tiling.dealt(self.target).select("tile", "pid", *names[1:])

        def pack(rows: pa.Table) -> pa.Table:
            ours = rows.column("pid").is_null().to_numpy()
            s, t = rows.filter(pa.array(ours)), rows.filter(pa.array(~ours))
            some = len(s) and len(t)
            return pa.table({"s": [arrays(s, ["x", "y", "z"]).tobytes()], "pid": [t.column("pid").to_numpy().astype(np.int64).tobytes()], "t": [arrays(t, names[1:]).tobytes()]} if some else {"s": [], "pid": [], "t": []}, schema=pa.schema([(c, pa.binary()) for c in ("s", "pid", "t")]))

        self.rows = durable(left.unionAll(right).groupBy("tile").applyInArrow(pack, "s binary, pid binary, t binary"))
        self.at = t

    def sums(self, t: np.ndarray, f, n: int) -> np.ndarray:
        """The sums of ``f(source, target, d2)``, n numbers, over the pairs of each source point, moved, and its nearest target point within reach."""
        if self.at is None or np.sqrt(((_moved(self.corners, t) - _moved(self.corners, self.at)) ** 2).sum(1)).max() > 0.5 * self.reach:
            self._deal(t)
        reach, width = self.reach, 6 if self.plane else 3

        def run(batches):
            for b in batches:
                for k in range(b.num_rows):
                    s, pid, to = (np.frombuffer(b.column(i)[k].as_py(), d) for i, d in enumerate((float, np.int64, float)))
                    s, to = _moved(s.reshape(-1, 3), t), to.reshape(-1, width)
                    tree = Tree(to[:, :3], pid)
                    point, d2 = tree.nearest(s, reach)
                    has = point >= 0
                    yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in f(s[has], to[tree.order[point[has]]], d2[has])], names=[f"v{i}" for i in range(n)])

        found = self.rows.select("s", "pid", "t").mapInArrow(run, ", ".join(f"v{i} double" for i in range(n)))
        return np.array([v or 0.0 for v in found.agg(*(F.sum(f"v{i}") for i in range(n))).first()], float)

    def discard(self) -> None:
        if self.rows is not None:
            discard(self.rows)


#: Points of a tile of an alignment, which is one row.
TILE_POINTS = 50_000


def _icp(source: PointFrame, target: PointFrame, reach: float, max_iterations: int, tolerance: float, init, plane: bool) -> Registration:
    """One job an iteration: the nearest neighbours, tile by tile, and one row of sums. Coordinates are taken from the target's centre."""
    if reach <= 0 or max_iterations < 1:
        raise ValidationError("distance and iterations are positive")
    n = source.nonempty().n
    init = matrix4(init)
    if plane:
        target.require("nx", "ny", "nz")
    held = durable(target.df.select("pid", "x", "y", "z", *(("nx", "ny", "nz") if plane else ())))
    target.with_df(held).nonempty()
    c = _centre(held)
    to_centre, back = np.eye(4), np.eye(4)
    to_centre[:3, 3], back[:3, 3] = -c, c
    src = durable(transformed(source.df.select("x", "y", "z"), to_centre))
    ends = src.where(finite("xyz")).agg(*(f(k) for f in (F.min, F.max) for k in "xyz")).first()
    if ends[0] is None:
        raise RegistrationError(f"0 correspondences within {reach}")
    dealt = _Dealt(src, transformed(held, to_centre), (np.array(ends[:3], float), np.array(ends[3:], float)), reach, plane)
    t = to_centre @ init @ back
    least, done, used = (6 if plane else 3), False, 0

    def planes(s, g, d2):
        off, normal = g[:, :3] - s, g[:, 3:]
        a = np.column_stack([np.cross(s, normal), normal])
        return [len(s), *(a.T @ a)[np.triu_indices(6)], *(a.T @ (off * normal).sum(1))]

    def points(s, g, d2):
        return [len(s), *s.sum(0), *g.sum(0), *(s.T @ g).ravel()]

    for used in range(1, max_iterations + 1):
        row = dealt.sums(t, planes if plane else points, 28 if plane else 16)
        if row[0] < least:
            raise RegistrationError(f"{int(row[0])} correspondences within {reach}")
        v = row[1:]
        step = np.eye(4)
        if plane:
            m = np.zeros((6, 6))
            m[np.triu_indices(6)] = v[:21]
            m = m + m.T - np.diag(np.diag(m))
            x = np.linalg.lstsq(m, v[21:], rcond=1e-12)[0]
            step[:3, :3], step[:3, 3] = rodrigues(x[:3]), x[3:]
        else:
            sm, tm = v[:3] / row[0], v[3:6] / row[0]
            step = kabsch(v[6:].reshape(3, 3) - row[0] * np.outer(sm, tm), sm, tm)
        before, t = t, step @ t
        if np.linalg.norm(t - before) < tolerance:
            done = True
            break
    k, d2 = dealt.sums(t, lambda s, g, d2: [len(s), d2.sum()], 2).tolist()
    dealt.discard()
    discard(src, held)
    return Registration(back @ t @ to_centre, k / n, math.sqrt(d2 / k) if k else 0.0, done, used)


def icp_point_to_point(source: PointFrame, target: PointFrame, max_correspondence_distance: float = 1.0, max_iterations: int = 50, tolerance: float = 1e-6, init_transform=None) -> Registration:
    """ICP with the closed-form rigid step (Kabsch)."""
    return _icp(source, target, max_correspondence_distance, max_iterations, tolerance, init_transform, False)


def icp_point_to_plane(source: PointFrame, target: PointFrame, max_correspondence_distance: float = 1.0, max_iterations: int = 50, tolerance: float = 1e-6, init_transform=None) -> Registration:
    """ICP along the target's normals, by 6 x 6 normal equations."""
    return _icp(source, target, max_correspondence_distance, max_iterations, tolerance, init_transform, True)


def icp(source: PointFrame, target: PointFrame, max_correspondence_distance: float = 1.0, max_iterations: int = 50, tolerance: float = 1e-6, init_transform=None, method: str = "auto") -> Registration:
    """Point to plane if the target has normals, else point to point; or as told."""
    if method not in ("auto", "point_to_point", "point_to_plane"):
        raise ValidationError("unknown method")
    plane = method == "point_to_plane" or method == "auto" and target.has("nx", "ny", "nz")
    return _icp(source, target, max_correspondence_distance, max_iterations, tolerance, init_transform, plane)


def compute_fpfh(cloud: PointFrame, radius: float, max_nn: int = 100) -> DataFrame:
    """(pid, fpfh): 33 histogram shares of angles between normals, a point's own and its neighbours', weighted by 1 / distance."""
    cloud.require("nx", "ny", "nz")
    if radius <= 0:
        raise ValidationError("the radius is positive")
    cloud.nonempty()
    given = cloud.df.select("pid", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")))
    lost = given.where(~finite("xyz")).select("pid", F.array(*(F.lit(0.0) for _ in range(3 * BINS))).alias("fpfh"))
    given = given.where(finite("xyz"))
    tiling = Tiling.of(given, "xyz", radius * (1 + 1e-9), 2)  # a neighbour's neighbours lie within twice the radius
    if tiling is None:
        return lost

    def run(tile: int, rows: pa.Table) -> pa.Table:
        pid, p, normals = rows.column("pid").to_numpy(), arrays(rows, ["x", "y", "z"]), arrays(rows, ["nx", "ny", "nz"])
        units = tiling.units(p)
        own = np.flatnonzero(tiling.owned(units, tile))
        out = np.zeros((0, 3 * BINS))
        if len(own):
            low, high = units[own].min(0), units[own].max(0)
            asked = np.flatnonzero((np.maximum(np.maximum(low - units, units - high), 0).max(1)) <= 1)
            shares = np.zeros((len(p), 3 * BINS))
            tree = Tree(p, pid)
            for some, which, point, d2 in tree.closest(p[asked], max_nn, radius):
                a, b = asked[some][which], tree.order[point]
                other = pid[a] != pid[b]
                counts = _angles(p, normals, a[other], b[other], d2[other], which[other], len(some))
                shares[asked[some]] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            out = shares[own] + _around(p, shares, own, radius)
            total = out.sum(1, keepdims=True)
            out = np.divide(out, total, out=np.zeros_like(out), where=total > 0)
        return pa.table({"pid": pid[own], "fpfh": pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, 3 * BINS, dtype=np.int32)), pa.array(out.ravel()))})

    return by_tile(tiling.dealt(given), run, "pid long, fpfh array<double>").unionByName(lost)


def _angles(p: np.ndarray, normals: np.ndarray, a: np.ndarray, b: np.ndarray, d2: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, 33) counts of the pairs' angles, by row, in the frame of a's normal u, the direction e to b, and their cross product w."""
    e = (p[b] - p[a]) / np.maximum(np.sqrt(d2), 1e-12)[:, None]
    u, m = normals[a], normals[b]

    def dot(x, y):
        return x[:, 0] * y[:, 0] + x[:, 1] * y[:, 1] + x[:, 2] * y[:, 2]

    w = np.stack([u[:, (k + 1) % 3] * e[:, (k + 2) % 3] - u[:, (k + 2) % 3] * e[:, (k + 1) % 3] for k in range(3)], axis=1)
    alpha = dot(w, m)
    out = np.zeros(n * 3 * BINS, np.int64)
    for k, (v, low, high) in enumerate(((alpha, -1.0, 1.0), (dot(e, u), -1.0, 1.0), (np.arctan2(alpha, dot(e, m)), -math.pi, math.pi))):
        told = (v >= low) & (v <= high)
        at = np.minimum(np.floor((v[told] - low) / ((high - low) / BINS)).astype(np.int64), BINS - 1)
        out += np.bincount(row[told] * 3 * BINS + k * BINS + at, minlength=len(out))
    return out.reshape(n, 3 * BINS).astype(float)


def _around(p: np.ndarray, shares: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
    """For each own point the mean of all others' shares within the radius, by 1 / distance: cell by cell, as products of matrices."""
    for part in (4, 2, 1):
        at = np.floor((p - p.min(0)) / (radius * (1 + 1e-9) / part)).astype(np.int64) + part
        dims = at.max(0) + 1 + part
        key = (at[:, 0] * dims[1] + at[:, 1]) * dims[2] + at[:, 2]
        if len(own) >= 16 * len(np.unique(key[own])):
            break
    order = np.argsort(key, kind="stable")
    x, h, key = p[order], shares[order], key[order]
    home = np.zeros(len(p), bool)
    home[own] = True
    mine = np.flatnonzero(home[order])
    first = np.flatnonzero(np.concatenate([[True], key[mine][1:] != key[mine][:-1]]))
    side = np.arange(-part, part + 1)
    lines = ((side[:, None] * dims[1] + side) * dims[2]).ravel()
    out = np.zeros((len(p), shares.shape[1]))
    for cell in np.split(mine, first[1:]):
        run = key[cell[0]] + lines
        lo, hi = np.searchsorted(key, run - part), np.searchsorted(key, run + part, "right")
        which, place = spread(hi - lo)
        near = lo[which] + place
        gap = np.maximum(np.maximum(x[cell].min(0) - x[near], x[near] - x[cell].max(0)), 0.0)
        near = near[(gap * gap).sum(1) <= radius * radius * (1 + 1e-9)]
        block = max(1, PAIRS // max(1, len(near)))
        for i in range(0, len(cell), block):
            some = cell[i : i + block]
            d2 = distance2(x[near][None], x[some][:, None])
            w = np.where(d2 <= radius * radius, 1 / np.maximum(np.sqrt(d2), 1e-12), 0.0)
            w[np.arange(len(some)), np.searchsorted(near, some)] = 0.0
            total = w.sum(1, keepdims=True)
            out[order[some]] = np.divide(w @ h[near], total, out=np.zeros((len(some), h.shape[1])), where=total > 0)
    return out[own]


def match_descriptors(source: DataFrame, target: DataFrame, column: str = "fpfh", max_target: int = 2_000_000) -> DataFrame:
    """(pid, match, d2): the nearest target descriptor of each source one (ties: lowest pid), exactly, by blocked products.

    The target side is broadcast, after its size is checked against ``max_target``.
    """
    n = target.count()
    if n > max_target:
        raise ValidationError(f"{n} target descriptors; down-sample to {max_target}")
    rows = target.select("pid", column).orderBy("pid").toPandas()
    shared = source.sparkSession.sparkContext.broadcast((rows.pid.to_numpy(np.int64), np.stack(rows[column].to_numpy()).astype(float)))

    def run(batches):
        ids, t = shared.value
        norms = (t * t).sum(1)
        for b in batches:
            s = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)
            best, far = np.zeros(len(s), np.int64), np.zeros(len(s))
            step = max(1, 4_000_000 // max(1, len(t)))
            for at in range(0, len(s), step):
                d = norms[None] - 2 * s[at : at + step] @ t.T
                k = d.argmin(1)
                best[at : at + step], far[at : at + step] = ids[k], ((s[at : at + step] - t[k]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best), pa.array(far)], names=["pid", "match", "d2"])

    return source.select("pid", column).mapInArrow(run, "pid long, match long, d2 double")


def fit_pairs(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    sm, tm = s.mean(0), t.mean(0)
    return kabsch((s - sm).T @ (t - tm), sm, tm)


#: Hypotheses that one pass over all matches scores.
BATCH = 500


def ransac_registration(source: PointFrame, target: PointFrame, source_features: DataFrame, target_features: DataFrame, max_correspondence_distance: float = 1.5, ransac_n: int = 3, max_iterations: int = 100_000, confidence: float = 0.999, seed: int = 0) -> Registration:
    """Coarse alignment from matched descriptors.

    Hypotheses are drawn from all matches and scored on all of them, BATCH a pass,
    until one that good would have been missed with a chance of ``1 - confidence`` at
    most; the best is fitted again to all its inliers. It counts as converged if that
    confidence was reached.
    """
    from terracell.operators.primitives import draw_hypotheses, score_hypotheses

    n = source.nonempty().n
    target.nonempty()
    if ransac_n < 3:
        raise ValidationError("a hypothesis needs three pairs")
    matched = match_descriptors(source_features, target_features)
    pairs = matched.join(source.df.select("pid", *(F.col(c).alias(f"s{c}") for c in "xyz")), "pid").join(target.df.select(F.col("pid").alias("match"), *(F.col(c).alias(f"t{c}") for c in "xyz")), "match")
    columns = tuple(f"{k}{c}" for k in "st" for c in "xyz")
    pairs = durable(pairs.select("pid", *columns))
    total = pairs.count()
    if total < ransac_n:
        raise RegistrationError("too few matched features")
    best, tried, sure, reach2 = (-1, np.eye(4)), 0, False, max_correspondence_distance**2
    while tried < max_iterations and not sure:
        drawn = draw_hypotheses(pairs, columns, ransac_n, min(BATCH, max_iterations - tried), seed + tried)
        found = np.stack([fit_pairs(q[:, :3], q[:, 3:]) for q in drawn])
        turn, shift = found[:, :3, :3], found[:, :3, 3]

        def score(x: np.ndarray, turn=turn, shift=shift) -> np.ndarray:
            off = np.einsum("hij,nj->nhi", turn, x[:, :3]) + shift - x[:, None, 3:]
            return ((off * off).sum(2) <= reach2).sum(0)

        inside = score_hypotheses(pairs, columns, len(drawn), score)
        tried += len(drawn)
        best = max(best, (int(inside.max()), found[int(inside.argmax())]), key=lambda x: x[0])
        missed = 1 - (best[0] / total) ** ransac_n  # that one hypothesis has an outlier
        sure = missed <= 0 or missed < 1 and tried * math.log(missed) <= math.log(1 - confidence)
    if best[0] < ransac_n:
        raise RegistrationError("no hypothesis has inliers")
    m = best[1]
    off = [sum((F.col(f"s{a}") * F.lit(float(m[i, j])) for j, a in enumerate("xyz")), F.lit(float(m[i, 3]))) - F.col(f"t{c}") for i, c in enumerate("xyz")]
    on = pairs.where(sum((o * o for o in off[1:]), off[0] * off[0]) <= reach2)
    sums = on.agg(*(F.avg(c).alias(c) for c in columns), *(F.covar_pop(f"s{a}", f"t{b}").alias(f"{a}{b}") for a in "xyz" for b in "xyz")).first()
    h = np.array([[sums[f"{a}{b}"] for b in "xyz"] for a in "xyz"])
    m = kabsch(h, np.array([sums[f"s{c}"] for c in "xyz"]), np.array([sums[f"t{c}"] for c in "xyz"]))
    k, d2 = _pairs(source.df, target.df, m, max_correspondence_distance).agg(F.count("*"), F.sum("d2")).first()
    return Registration(m, k / n, math.sqrt(d2 / k) if k else 0.0, bool(sure), tried)


@dataclass(frozen=True)
class Alignment:
    transforms: list[np.ndarray]
    pairwise: list[Registration]

    @property
    def mean_rmse(self) -> float:
        return float(np.mean([r.inlier_rmse for r in self.pairwise])) if self.pairwise else 0.0

    def table(self, spark: SparkSession) -> DataFrame:
        """(scan, m00 ... m33, fitness, rmse); the first scan is the frame."""
        rows = []
        for k, m in enumerate(self.transforms):
            r = self.pairwise[k - 1] if k else None
            rows.append((k, *(float(x) for x in m.ravel()), r.fitness if r else 1.0, r.inlier_rmse if r else 0.0))
        cells = ", ".join(f"m{i}{j} double" for i in range(4) for j in range(4))
        return spark.createDataFrame(rows, f"scan int, {cells}, fitness double, rmse double")


def align_scans(clouds: list[PointFrame], voxel_size: float | None = None, max_correspondence_distance: float = 1.0, max_iterations: int = 50, compose: str = "chain") -> Alignment:
    """Each scan onto the one before, chained to the first scan's frame.

    ``voxel_size`` thins the clouds first. compose="chain" gives T(0<-i) = T(0<-i-1) T(i-1<-i);
    compose="left" multiplies in the other order, which differs from three scans on.
    """
    from terracell.operators.filters import voxel_downsample

    if len(clouds) < 2:
        raise RegistrationError("alignment needs two clouds")
    thin = [voxel_downsample(c, voxel_size) for c in clouds] if voxel_size else clouds
    out, found = [np.eye(4)], []
    for a, b in zip(thin, thin[1:], strict=False):
        found.append(icp(b, a, max_correspondence_distance, max_iterations))
        step = found[-1].transform
        out.append(out[-1] @ step if compose == "chain" else step @ out[-1])
    return Alignment(out, found)
