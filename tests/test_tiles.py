"""Searches tile by tile, against brute force, on clouds that need many tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators import cluster, registration, shape
from terracell.plans import density, neighbours, tiles
from terracell.sources import formats
from terracell.sources.formats import from_arrays
from test_neighbourhoods import distances, plain_dbscan


def no_pairs(*args, **kwargs):
    raise AssertionError("a table of pairs was made")


@pytest.mark.parametrize("axes", ["xyz", "xy"])
@pytest.mark.parametrize("samples", [1, 3, 12])
def test_dbscan_by_tiles_makes_no_pairs(spark, monkeypatch, axes, samples):
    monkeypatch.setattr(tiles, "ROWS", 150)
    monkeypatch.setattr(density, "TRIED", 1)
    monkeypatch.setattr(neighbours, "radius_pairs", no_pairs)
    rng = np.random.default_rng(samples)
    p = np.vstack([np.round(rng.random((500, 3)) * [30, 30, 6], 1), rng.normal(size=(300, 3)) * 0.4 + [8, 8, 2], np.column_stack([np.linspace(0, 30, 200), np.full(200, 15.0), np.full(200, 3.0)])])
    p = p[rng.permutation(len(p))]
    c = from_arrays(spark, p)
    assert len({r.tile for r in tiles.Tiling.of(c.df, axes, density.cell_edge(1.0, len(axes)), density.HALO).home(c.df).collect()}) > 3
    got = cluster.cluster_dbscan(c, 1.0, samples, axes == "xy").orderBy("pid").toPandas().label.to_numpy()
    assert (got == plain_dbscan(p[:, : len(axes)], 1.0, samples)).all()


def test_points_without_a_place_are_noise(spark):
    c = from_arrays(spark, [[0, 0, 0], [0.1, 0, 0], [5, 5, 5], [np.nan, 0, 0], [np.inf, 0, 0]])
    c = c.with_df(c.df.withColumn("x", F.when(F.col("pid") != 2, F.col("x"))))
    assert {r.pid: r.label for r in cluster.cluster_dbscan(c, 1.0, 1).collect()} == {0: 0, 1: 0, 2: -1, 3: -1, 4: -1}


@pytest.mark.parametrize("axes", ["xyz", "xy"])
def test_nearest_by_tiles_makes_no_pairs(spark, monkeypatch, axes):
    monkeypatch.setattr(tiles, "ROWS", 60)
    monkeypatch.setattr(neighbours, "radius_pairs", no_pairs)
    rng = np.random.default_rng(4)
    p, q = np.round(rng.random((400, 3)) * [20, 20, 5], 1), np.round(rng.random((300, 3)) * [24, 24, 5] - 2, 1)
    got = {r.a_pid: (r.b_pid, r.d2, r.b_z, r.dx) for r in neighbours.nearest_within(from_arrays(spark, q).df, from_arrays(spark, p).df, 0.9, axes, keep_b=("z",)).collect()}
    k = len(axes)
    d = sum((p[None, :, i] - q[:, None, i]) ** 2 for i in range(k))
    want = {i: (int(j), d[i, j], p[j, 2], p[j, 0] - q[i, 0]) for i, j in enumerate(d.argmin(1)) if d[i, j] <= 0.9 * 0.9}
    assert got == want and len(want) > 40


@pytest.mark.parametrize("method", ["point_to_point", "point_to_plane"])
def test_icp_by_tiles_makes_no_pairs(spark, monkeypatch, method):
    """Far enough for tiles to be dealt again; each iteration's pairs are those of brute force."""
    monkeypatch.setattr(registration, "TILE_POINTS", 60)
    monkeypatch.setattr(neighbours, "radius_pairs", no_pairs)
    rng = np.random.default_rng(6)
    p = rng.random((500, 3)) * [12, 12, 4]
    n = rng.normal(size=p.shape)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    target = from_arrays(spark, p, nx=n[:, 0], ny=n[:, 1], nz=n[:, 2])
    s = p + [0.5, -0.4, 0.3]
    deals, deal = [], registration._Dealt._deal
    monkeypatch.setattr(registration._Dealt, "_deal", lambda self, t: (deals.append(1), deal(self, t)))
    found = registration.icp(from_arrays(spark, s), target, 1.0, 12, 1e-9, method=method)
    t = np.eye(4)
    for _ in range(found.n_iterations):
        x = s @ t[:3, :3].T + t[:3, 3]
        d2 = distances(x, p)
        near, has = d2.argmin(1), d2.min(1) <= 1
        x, g, m = x[has], p[near[has]], n[near[has]]
        step = np.eye(4)
        if method == "point_to_point":
            step = registration.fit_pairs(x, g)
        else:
            c = p.mean(0)
            a = np.column_stack([np.cross(x - c, m), m])
            v = np.linalg.lstsq(a, ((g - x) * m).sum(1), rcond=None)[0]
            step[:3, :3] = registration.rodrigues(v[:3])
            step[:3, 3] = v[3:] + c - step[:3, :3] @ c
        t = step @ t
    x = s @ t[:3, :3].T + t[:3, 3]
    d2 = distances(x, p).min(1)
    assert np.abs(found.transform - t).max() < 1e-6 and found.fitness == (d2 <= 1).mean() and found.inlier_rmse == pytest.approx(np.sqrt(d2[d2 <= 1].mean()))
    assert len(deals) > 1


def test_moments_of_the_closest_make_no_pairs(spark, monkeypatch):
    """Rounds with growing reach: dense points settle first, lonely ones last."""
    monkeypatch.setattr(tiles, "ROWS", 100)
    monkeypatch.setattr(shape, "radius_pairs", no_pairs)
    rng = np.random.default_rng(8)
    p = np.vstack([rng.random((500, 3)) * [10, 10, 3], np.round(rng.random((100, 3)) * [40, 40, 3], 1), [[90, 90, 0]]])
    c = from_arrays(spark, p)
    rows = {r.pid: r for r in shape.moments(c.df, c.df, 5.0, 7).collect()}
    d2 = distances(p, p)
    assert len(rows) == len(p)
    for k in range(len(p)):
        near = [j for j in np.lexsort((np.arange(len(p)), d2[k])) if d2[k, j] <= 25][:7]
        d = p[near] - p[k]
        assert rows[k].n == len(near) and rows[k].s_x == pytest.approx(d[:, 0].sum()) and rows[k].s_yz == pytest.approx((d[:, 1] * d[:, 2]).sum())


@pytest.mark.parametrize("suffix", [".las", ".ply", ".xyz"])
def test_files_are_written_without_gathering_the_points(spark, monkeypatch, tmp_path, suffix):
    monkeypatch.setattr(formats, "TASK_POINTS", 300)
    monkeypatch.setattr(formats, "BATCH_POINTS", 70)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", no_pairs)
    p = np.round(np.random.default_rng(1).random((1000, 3)) * 50, 2)
    path = str(tmp_path / f"cloud{suffix}")
    formats.write(from_arrays(spark, p), path)
    rows = formats.read(spark, path).df.orderBy("pid").select("x", "y", "z").collect()
    assert np.allclose(np.array(rows, float), p, atol=1e-6)


def test_descriptors_by_tiles_make_no_pairs(spark, monkeypatch):
    """Over many tiles as over one; the one is held against brute force."""
    monkeypatch.setattr(shape, "radius_pairs", no_pairs)
    rng = np.random.default_rng(3)
    p = np.round(rng.random((400, 3)) * [12, 12, 3], 1)
    n = rng.normal(size=p.shape)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    c = from_arrays(spark, p, nx=n[:, 0], ny=n[:, 1], nz=n[:, 2])
    d2, own = distances(p, p), np.zeros((400, 33))
    for a in range(400):
        near = [b for b in np.lexsort((np.arange(400), d2[a])) if d2[a, b] <= 1.44][:6]
        for b in near:
            if a != b:
                e = (p[b] - p[a]) / max(np.sqrt(d2[a, b]), 1e-12)
                w = np.cross(n[a], e)
                for k, (v, low, high) in enumerate(((w @ n[b], -1, 1), (e @ n[a], -1, 1), (np.arctan2(w @ n[b], e @ n[b]), -np.pi, np.pi))):
                    own[a, 11 * k + min(10, int((v - low) / ((high - low) / 11)))] += 1
    own /= np.maximum(own.sum(1, keepdims=True), 1)
    w = np.where(d2 <= 1.44, 1 / np.maximum(np.sqrt(d2), 1e-12), 0)
    np.fill_diagonal(w, 0)
    want = own + w @ own / np.maximum(w.sum(1, keepdims=True), 1e-300)
    want /= np.maximum(want.sum(1, keepdims=True), 1e-300)
    for rows in (100_000, 40):
        monkeypatch.setattr(tiles, "ROWS", rows)
        got = registration.compute_fpfh(c, 1.2, 6).orderBy("pid").collect()
        assert len(got) == 400 and np.allclose([r.fpfh for r in got], want, atol=1e-9)
