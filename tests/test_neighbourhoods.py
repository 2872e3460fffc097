"""Spatial joins and what is built on them, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.errors import FeatureError, SegmentationError, ValidationError
from terracell.frame import PointFrame
from terracell.operators import cluster, filters, registration, shape
from terracell.plans.components import connected_components
from terracell.plans.neighbours import nearest_k, nearest_within, radius_pairs
from terracell.sources.formats import from_arrays


def cloud(spark, n=300, seed=1, scale=(10, 10, 4)):
    xyz = np.random.default_rng(seed).random((n, 3)) * scale
    return from_arrays(spark, xyz), xyz


def distances(a, b):
    return ((a[:, None] - b[None]) ** 2).sum(-1)


@pytest.mark.parametrize("axes", ["xyz", "xy"])
def test_radius_pairs(spark, axes):
    c, p = cloud(spark)
    d = distances(p[:, : len(axes)], p[:, : len(axes)])
    got = {(r.a_pid, r.b_pid) for r in radius_pairs(c.df, c.df, 1.5, axes).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 2.25), strict=True)}


@pytest.mark.parametrize("edge", [None, 0.3])
def test_nearest_k(spark, edge):
    c, p = cloud(spark, 200)
    far = np.vstack([p, [[500, 500, 0]]])
    c = from_arrays(spark, far)
    d = distances(far, far)
    got = {}
    for r in nearest_k(c.df, c.df, 5, edge=edge).collect():
        got.setdefault(r.a_pid, {})[r.n] = r.b_pid
    for k in range(len(far)):
        assert [got[k][n] for n in range(1, 6)] == np.lexsort((np.arange(len(far)), d[k]))[:5].tolist()


def test_nearest_within_takes_lowest_pid_of_ties(spark):
    a = from_arrays(spark, [[0, 0, 0], [50, 0, 0]]).df
    b = from_arrays(spark, [[1, 0, 0], [-1, 0, 0], [0, 3, 0]]).df
    rows = nearest_within(a, b, 2.0).collect()
    assert [(r.a_pid, r.b_pid, r.d2) for r in rows] == [(0, 0, 1.0)]


def test_outlier_filters(spark):
    rng = np.random.default_rng(7)
    p = np.vstack([rng.normal(size=(200, 3)), rng.normal(size=(5, 3)) + 100])
    c = from_arrays(spark, p)
    kept, mask = filters.statistical_outlier_removal(c, 10, 2.0)
    d = np.sqrt(np.sort(distances(p, p), axis=1)[:, 1:11]).mean(1)
    want = set(np.flatnonzero(d <= d.mean() + 2 * d.std()).tolist())
    assert {r.pid for r in kept.df.collect()} == want and mask.count() == len(p)
    kept, _ = filters.radius_outlier_removal(c, 1.0, 3)
    near = (distances(p, p) <= 1).sum(1) - 1
    assert {r.pid for r in kept.df.collect()} == set(np.flatnonzero(near >= 3).tolist())
    for bad in (lambda: filters.statistical_outlier_removal(c, 205), lambda: filters.radius_outlier_removal(c, -1), lambda: filters.crop(c, (0, 0, 0, 0, 1, 1))):
        with pytest.raises(ValidationError):
            bad()


def test_voxels_and_samples(spark):
    c, p = cloud(spark, 500)
    keys = np.floor((p - p.min(0)) / 2).astype(int)
    first = {}
    for k, key in enumerate(map(tuple, keys)):
        first.setdefault(key, k)
    assert {r.pid for r in filters.voxel_downsample(c, 2.0).df.collect()} == set(first.values())
    assert filters.voxel_downsample(c, 2.0, "centroid").df.count() == len(first)
    for k in (0.5, 0.001, 1.0):
        ids = [r.pid for r in filters.random_downsample(c, k, 3).df.collect()]
        assert len(ids) == len(set(ids)) == max(1, int(500 * k))
    again = [{r.pid for r in filters.random_downsample(c, 0.3, s).df.collect()} for s in (1, 1, 2)]
    assert again[0] == again[1] != again[2]


def test_features_and_normals(spark):
    c, p = cloud(spark, 250)
    got = {r.pid: r for r in shape.geometric_features(c, 2.0, 12).collect()}
    normals = {r.pid: np.array([r.nx, r.ny, r.nz]) for r in shape.estimate_normals(c, 2.0, 12).df.collect()}
    d = distances(p, p)
    for k in range(len(p)):
        near = [j for j in np.lexsort((np.arange(len(p)), d[k])) if d[k, j] <= 4][:12]
        assert got[k].n == len(near)
        if len(near) < 3:
            assert got[k].linearity == 0 and tuple(normals[k]) == (0, 0, 1)
            continue
        values, vectors = np.linalg.eigh(np.cov(p[near].T, ddof=0))
        l3, l2, l1 = np.maximum(values, 0)
        assert got[k].linearity == pytest.approx((l1 - l2) / l1, abs=1e-9)
        assert got[k].omnivariance == pytest.approx(np.cbrt(l1 * l2 * l3), abs=1e-6)
        assert np.linalg.norm(normals[k]) == pytest.approx(1)
        if l2 - l3 > 1e-3 and len(near) > 3:
            assert abs(normals[k] @ vectors[:, 0]) == pytest.approx(1, abs=1e-6)
    with pytest.raises(FeatureError):
        shape.geometric_features(from_arrays(spark, [[0, 0, 0]]), 1.0)


def test_flat_and_collinear_normals(spark):
    rng = np.random.default_rng(0)
    flat = from_arrays(spark, np.column_stack([rng.random((100, 2)), np.zeros(100)]))
    assert all(r.nz == pytest.approx(1) for r in shape.estimate_normals(flat, 0.5).df.collect())
    line = from_arrays(spark, np.column_stack([np.arange(10) / 10, np.zeros(10), np.zeros(10)]))
    rows = shape.estimate_normals(line, 0.5).df.collect()
    assert all(np.hypot(np.hypot(r.nx, r.ny), r.nz) == pytest.approx(1) and abs(r.nx) < 1e-6 for r in rows)


def plain_dbscan(p, eps, least):
    near = distances(p, p) <= eps * eps
    core, label = near.sum(1) >= least, np.full(len(p), -1)
    c = 0
    for k in range(len(p)):
        if core[k] and label[k] < 0:
            todo = [k]
            while todo:
                i = todo.pop()
                if label[i] < 0:
                    label[i] = c
                    if core[i]:
                        todo += [j for j in np.flatnonzero(near[i]) if label[j] < 0]
            c += 1
    return label


def test_dbscan(spark):
    rng = np.random.default_rng(3)
    p = np.vstack([rng.normal(size=(60, 3)), rng.normal(size=(60, 3)) + [20, 0, 0], rng.random((30, 3)) * 30])
    p = p[rng.permutation(len(p))]
    got = cluster.cluster_dbscan(from_arrays(spark, p), 1.1, 5).orderBy("pid").toPandas().label.to_numpy()
    assert (got == plain_dbscan(p, 1.1, 5)).all()
    with pytest.raises(SegmentationError):
        cluster.cluster_dbscan(from_arrays(spark, p), 0)


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def turned(p, degrees=4.0, shift=(0.3, -0.2, 0.1)):
    a = np.radians(degrees)
    m = np.eye(4)
    m[:2, :2] = [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]
    m[:3, 3] = shift
    return p @ m[:3, :3].T + m[:3, 3], m


@pytest.mark.parametrize("method", ["point_to_point", "point_to_plane"])
def test_icp_recovers_a_rigid_move(spark, method):
    rng = np.random.default_rng(2)
    p = np.vstack([np.column_stack([rng.random((150, 2)) * 10, np.zeros(150)]), np.column_stack([rng.random(100) * 10, np.zeros(100), rng.random(100) * 6]), np.column_stack([np.zeros(100), rng.random(100) * 10, rng.random(100) * 6])])
    p += [500_000, 4_000_000, 100]
    normals = np.vstack([np.tile([0, 0, 1.0], (150, 1)), np.tile([0, 1.0, 0], (100, 1)), np.tile([1.0, 0, 0], (100, 1))])
    q = p.copy()
    c = p.mean(0)
    moved, m = turned(p - c, 1.0, (0.1, -0.1, 0.05))
    target = from_arrays(spark, q, nx=normals[:, 0], ny=normals[:, 1], nz=normals[:, 2])
    found = registration.icp(from_arrays(spark, moved + c), target, 1.0, 25, method=method)
    back = (moved + c) @ found.transform[:3, :3].T + found.transform[:3, 3]
    assert np.abs(back - p).max() < 1e-3 and found.fitness == 1 and found.inlier_rmse < 1e-3
    assert registration.icp(target, target, 0.5, 3).inlier_rmse == pytest.approx(0)


def test_registration_pieces(spark):
    assert np.allclose(registration.rodrigues(np.zeros(3)), np.eye(3))
    s = np.random.default_rng(1).random((10, 3))
    t, m = turned(s, 30, (1, 2, 3))
    assert np.allclose(registration.fit_pairs(s, t), m)
    with pytest.raises(ValidationError):
        registration.matrix4(np.eye(3))
    c = from_arrays(spark, s)
    with pytest.raises(ValidationError):
        registration.icp(c, c, method="other")
    with pytest.raises(ValidationError):
        registration.compute_fpfh(c, 1.0)


def test_fpfh_and_ransac(spark):
    rng = np.random.default_rng(5)
    p = rng.random((120, 3)) * [6, 6, 2]
    n = rng.normal(size=(120, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    q, m = turned(p, 40, (3, 1, 0))
    nq = n @ m[:3, :3].T
    a, b = (from_arrays(spark, x, nx=v[:, 0], ny=v[:, 1], nz=v[:, 2]) for x, v in ((p, n), (q, nq)))
    fa, fb = registration.compute_fpfh(a, 2.0), registration.compute_fpfh(b, 2.0)
    rows = fa.collect()
    assert all(len(r.fpfh) == 33 and min(r.fpfh) >= 0 and sum(r.fpfh) == pytest.approx(1) for r in rows)
    found = registration.ransac_registration(a, b, fa, fb, 0.05, max_iterations=5000)
    assert np.abs(found.transform - m).max() < 0.02 and found.converged and found.n_iterations < 5000


def test_three_scans_chain(spark):
    rng = np.random.default_rng(9)
    p = rng.random((200, 3)) * [8, 8, 3]
    q, a = turned(p, 2, (0.05, 0, 0))
    w, b = turned(q, 2, (0, 0.05, 0))
    out = registration.align_scans([from_arrays(spark, w), from_arrays(spark, q), from_arrays(spark, p)], max_correspondence_distance=0.6, max_iterations=30)
    assert np.abs(out.transforms[2] - b @ a).max() < 1e-2 and len(out.pairwise) == 2


def test_orient_and_knn_features(spark):
    c = from_arrays(spark, [[0, 0, 0], [1, 0, 0], [2, 0, 0], [3, 0, 0.0]])
    rows = shape.knn_features(c.df, 4).collect()
    assert all(r.linearity == pytest.approx(1) for r in rows)
    n = c.df.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(-1.0)})
    assert {r.nz for r in shape.orient_normals_to_viewpoint(PointFrame(n), (0, 0, 10)).df.collect()} == {1.0}
