"""Planes and cylinders by RANSAC: hypotheses come from points drawn by hash from the whole cloud, anew each round, and are scored by passes over all of it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.errors import FeatureError, ValidationError
from terracell.frame import PointFrame
from terracell.functions.eigen import PAIRS
from terracell.operators.filters import exact_sample
from terracell.plans.durable import durable

#: Bins of the greatest radius by which a cylinder's median radius is told, over all points, where points have no normals.
RADIUS_BINS = 1024


def draw_hypotheses(df: DataFrame, columns: tuple, each: int, h: int, seed: int) -> list[np.ndarray]:
    """h hypotheses' points, ``each`` a hypothesis: a sample of the whole cloud, dealt out in random order; drawn again where the cloud has fewer."""
    p = exact_sample(df, each * h, seed).orderBy("pid").select(*columns).toPandas().to_numpy(float)
    rng, out = np.random.default_rng(seed), []
    while len(out) < h and len(p) >= each:
        order = rng.permutation(len(p))
        out += [p[order[k : k + each]] for k in range(0, len(p) - each + 1, each)]
    return out[:h]


@dataclass(frozen=True)
class Plane:
    """normal . p + d = 0; ``inliers`` has the pids; rmse of their distances."""

    normal: np.ndarray
    d: float
    n_inliers: int
    rmse: float
    inliers: DataFrame

    def distance(self):
        return _offset(self.normal, self.d)


@dataclass(frozen=True)
class Cylinder:
    axis_point: np.ndarray
    axis: np.ndarray
    radius: float
    n_inliers: int
    rmse: float
    inliers: DataFrame


def _offset(n: np.ndarray, d: float):
    return F.col("x") * F.lit(float(n[0])) + F.col("y") * F.lit(float(n[1])) + F.col("z") * F.lit(float(n[2])) + F.lit(float(d))


def score_hypotheses(df: DataFrame, columns: tuple, h: int, score) -> np.ndarray:
    """Inliers of each of h hypotheses: a vector a task, summed by Spark."""

    def run(batches):
        total = np.zeros(h, np.int64)
        for b in batches:
            p = np.column_stack([c.to_numpy() for c in b.columns])
            for at in range(0, len(p), 2048):
                total += score(p[at : at + 2048])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(h)), pa.array(total)], names=["h", "n"])

    rows = df.select(*columns).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(h, np.int64)
    for r in rows:
        out[r.h] = r.n
    return out


def detect_planes(cloud: PointFrame, distance_threshold: float = 0.02, ransac_n: int = 3, num_iterations: int = 1000, max_planes: int = 10, min_points: int = 100, seed: int = 0) -> list[Plane]:
    """Planes in the order found, each refitted to its inliers, which the next ones don't see."""
    if distance_threshold <= 0 or ransac_n < 3:
        raise ValidationError("the threshold is positive and a plane has three points")
    if cloud.nonempty(FeatureError).n < max(3, ransac_n):
        raise FeatureError("too few points for a plane")
    c = np.array([(lo + hi) / 2 for lo, hi in zip(cloud.bounds.low, cloud.bounds.high, strict=True)])
    left = durable(cloud.df.select("pid", *((F.col(a) - F.lit(float(m))).alias(a) for a, m in zip("xyz", c, strict=True))))
    found = []
    while len(found) < max_planes:
        if left.count() < max(ransac_n, min_points):
            break
        normals, ds = [], []
        for q in draw_hypotheses(left, ("x", "y", "z"), ransac_n, num_iterations, seed + len(found)):
            n = np.linalg.svd(q - q.mean(0))[2][2]
            normals.append(n)
            ds.append(-n @ q.mean(0))
        normals, ds = np.array(normals), np.array(ds)
        inside = score_hypotheses(left, ("x", "y", "z"), num_iterations, lambda x, n=normals, d=ds: (np.abs(x @ n.T + d) <= distance_threshold).sum(0))
        best = int(inside.argmax())
        if inside[best] < min_points:
            break
        near = left.where(F.abs(_offset(normals[best], ds[best])) <= distance_threshold)
        row = near.agg(F.count("*"), *(F.sum(a) for a in "xyz"), *(F.sum(F.col(k[0]) * F.col(k[1])) for k in PAIRS)).first()
        mean, second = np.array(row[1:4]) / row[0], np.zeros((3, 3))
        second[np.triu_indices(3)] = np.array(row[4:]) / row[0]
        cov = second + second.T - np.diag(np.diag(second)) - np.outer(mean, mean)
        n = np.linalg.eigh(cov)[1][:, 0]
        n = n if n @ normals[best] >= 0 else -n
        d = float(-n @ mean)
        on = durable(left.where(F.abs(_offset(n, d)) <= distance_threshold).select("pid", _offset(n, d).alias("e")))
        k, e2 = on.agg(F.count("*"), F.sum(F.col("e") * F.col("e"))).first()
        found.append(Plane(n, float(d - n @ c), k, float(np.sqrt(e2 / k)) if k else 0.0, on.select("pid")))
        if not k:
            break
        left = durable(left.join(on.select("pid"), "pid", "left_anti"))
    return found


def _median_radii(df: DataFrame, h: int, far, high: float) -> np.ndarray:
    """Each axis's median distance over all points, to half a bin; infinite beyond ``high``."""
    bins = RADIUS_BINS + 1

    def run(batches):
        total = np.zeros(h * bins, np.int64)
        for b in batches:
            p = np.column_stack([c.to_numpy() for c in b.columns])
            for at in range(0, len(p), 512):
                d = np.minimum(far(p[at : at + 512]) * (RADIUS_BINS / high), RADIUS_BINS).astype(np.int64)
                total += np.bincount((d + np.arange(h) * bins).ravel(), minlength=h * bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(h)), pa.array(list(total.reshape(h, bins)), pa.list_(pa.int64()))], names=["h", "n"])

    def middle(rows):
        import pandas as pd

        total = np.sum(np.stack(rows.n), axis=0)
        k = int(np.searchsorted(np.cumsum(total), total.sum() / 2))
        return pd.DataFrame({"h": [rows.h.iloc[0]], "r": [(k + 0.5) * high / RADIUS_BINS if k < RADIUS_BINS else np.inf]})

    out = np.full(h, np.inf)
    for r in df.select("x", "y", "z").mapInArrow(run, "h long, n array<long>").groupBy("h").applyInPandas(middle, "h long, r double").collect():
        out[r.h] = r.r
    return out


def detect_cylinders(cloud: PointFrame, distance_threshold: float = 0.02, radius_range: tuple[float, float] = (0.01, 2.0), num_iterations: int = 5000, min_points: int = 100, seed: int = 0) -> list[Cylinder]:
    """The best cylinder, or none. The axis is across two points' normals and through where they meet; without normals, along the two points."""
    low, high = radius_range
    if distance_threshold <= 0 or not 0 < low < high:
        raise ValidationError("threshold and radii are positive, the range ascends")
    if cloud.nonempty(FeatureError).n < 6:
        raise FeatureError("too few points for a cylinder")
    has = cloud.has("nx", "ny", "nz")
    columns = ("x", "y", "z", *(("nx", "ny", "nz") if has else ()))
    c = np.array([(lo + hi) / 2 for lo, hi in zip(cloud.bounds.low, cloud.bounds.high, strict=True)])
    pts = durable(cloud.df.select("pid", *((F.col(a) - F.lit(float(m))).alias(a) for a, m in zip("xyz", c, strict=True)), *columns[3:]))
    axes, origins, radii = [], [], []
    for p in draw_hypotheses(pts, columns, 2, num_iterations, seed):
        a, b = p[:, :3]
        if has:
            axis = np.cross(p[0, 3:], p[1, 3:])
            size = np.linalg.norm(axis)
            if size < 1e-6:
                continue
            axis /= size
            # Where the two normal lines come closest, seen along the axis.
            m = np.column_stack([p[0, 3:], -p[1, 3:], axis])
            if abs(np.linalg.det(m)) < 1e-9:
                continue
            origin = a + np.linalg.solve(m, b - a)[0] * p[0, 3:]
        else:
            axis, size = b - a, np.linalg.norm(b - a)
            if size < 1e-9:
                continue
            axis, origin = axis / size, a
        axes.append(axis), origins.append(origin)
        radii.append(float(np.linalg.norm((a - origin) - ((a - origin) @ axis) * axis)) if has else 0.0)
    if not axes:
        return []
    axes, origins, radii = np.array(axes), np.array(origins), np.array(radii)

    def far(x: np.ndarray, axes=axes, origins=origins) -> np.ndarray:
        v2 = (x * x).sum(1)[:, None] - 2 * x @ origins.T + (origins * origins).sum(1)
        along = x @ axes.T - (origins * axes).sum(1)
        return np.sqrt(np.maximum(0, v2 - along * along))

    if not has:
        radii = _median_radii(pts, len(axes), far, high)
    fit = (radii >= low) & (radii <= high)
    if not fit.any():
        return []
    axes, origins, radii = axes[fit], origins[fit], radii[fit]
    inside = score_hypotheses(pts, ("x", "y", "z"), len(axes), lambda x: (np.abs(far(x, axes, origins) - radii) <= distance_threshold).sum(0))
    k = int(inside.argmax())
    if inside[k] < min_points:
        return []
    d = {a: F.col(a) - F.lit(float(o)) for a, o in zip("xyz", origins[k], strict=True)}
    along = d["x"] * F.lit(float(axes[k][0])) + d["y"] * F.lit(float(axes[k][1])) + d["z"] * F.lit(float(axes[k][2]))
    e = F.sqrt(F.greatest(F.lit(0.0), d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"] - along * along)) - F.lit(float(radii[k]))
    on = durable(pts.select("pid", e.alias("e")).where(F.abs("e") <= distance_threshold))
    n, e2 = on.agg(F.count("*"), F.sum(F.col("e") * F.col("e"))).first()
    return [Cylinder(origins[k] + c, axes[k], float(radii[k]), n, float(np.sqrt(e2 / n)) if n else 0.0, on.select("pid"))]
