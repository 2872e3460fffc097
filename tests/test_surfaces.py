"""Rasters, ground, trees, change, profiles, tiles, exports, files, colours, models, meshes, CLI."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.cli import main
from terracell.errors import ChangeError, CodecError, ExportError, ModelError, PlatformError, RasterError, SegmentationError, StorageError, TerracellError, ValidationError
from terracell.frame import Acquisition, PointFrame, ScanPosition, platform_of
from terracell.functions import crs
from terracell.operators import change, cluster, colour, export, filters, ground, mesh, metrics, model, powerlines, primitives, raster, tiling
from terracell.plans.grid import GridSpec
from terracell.sources import formats
from terracell.sources.formats import from_arrays
from terracell.streaming import ingest


def terrain(spark, n=800, seed=2, platform="aerial"):
    rng = np.random.default_rng(seed)
    p = np.column_stack([rng.random((n, 2)) * 20, rng.random(n) * 0.1])
    high = np.arange(n) % 3 == 0
    p[high, 2] += 1 + 5 * rng.random(high.sum())
    return from_arrays(spark, p, Acquisition(platform=platform), classification=np.where(high, 1, 2).astype("u1")), p, high


def test_statistics_and_density(spark):
    c, p, _ = terrain(spark)
    s = metrics.cloud_statistics(c).first()
    assert s.z_p25 == pytest.approx(np.percentile(p[:, 2], 25)) and s.z_std == pytest.approx(p[:, 2].std()) and s.intensity_mean is None
    d = metrics.point_density(c, 3.0)
    assert d.agg(F.sum("count")).first()[0] == len(p)
    assert d.count() == np.prod([len(np.arange(v.min(), v.max() + 3, 3)) - 1 for v in (p[:, 0], p[:, 1])])
    cover = metrics.coverage_statistics(c, 3.0).first()
    assert 0 <= cover.gap_fraction < 1 and cover.covered_area <= cover.total_area


def test_canopy(spark):
    c, p, high = terrain(spark)
    chm = metrics.canopy_height_model(c, 2.0).toPandas()
    assert chm.chm.min() >= 0 and 4 < chm.chm.max() < 6.2
    with pytest.raises(PlatformError):
        metrics.canopy_height_model(PointFrame(c.df, Acquisition(platform="terrestrial")))
    with pytest.raises(ValidationError):
        metrics.canopy_height_model(PointFrame(c.df.drop("classification")))


def test_interpolation(spark):
    p = from_arrays(spark, [[0, 0, 1], [10, 0, 2], [0, 10, 3], [10, 10, 4], [5, 5, 2.5]])
    q = spark.createDataFrame([(0, 0, 5.0, 5.0), (0, 1, 0.1, 0.1), (0, 2, 99.0, 99.0)], "row long, col long, x double, y double")
    idw = {r.col: r.value for r in raster.idw_interpolate(q, p.df, max_dist=20.0).collect()}
    assert idw[0] == 2.5 and 1 <= idw[1] < 1.1 and idw[2] == raster.NODATA
    near = {r.col: r.value for r in raster.nearest_interpolate(q, p.df, 1.0).collect()}
    assert near == {0: 2.5, 1: 1.0, 2: raster.NODATA}
    with pytest.raises(RasterError):
        raster.idw_interpolate(q, p.df, power=0)


def test_dsm_keeps_the_highest_and_dtm_the_ground(spark):
    three = from_arrays(spark, [[0.5, 0.5, 5], [0.5, 0.5, 10], [0.5, 0.5, 3]])
    assert [r.value for r in raster.create_dsm(three).df.collect()] == [10]
    c, _, _ = terrain(spark)
    dtm = raster.create_dtm(c, 2.0)
    assert dtm.df.agg(F.max("value")).first()[0] < 0.2 and dtm.df.count() == dtm.grid.cells
    assert raster.create_dsm(c, 2.0).df.agg(F.max("value")).first()[0] > 4
    for bad in (lambda: raster.create_dsm(c, 0), lambda: raster.create_dsm(c, 1, "other"), lambda: raster.create_dtm(PointFrame(c.df.drop("classification")))):
        with pytest.raises(RasterError):
            bad()


def plane(spark, f, n=12, res=2.0):
    grid = GridSpec(0, 0, res, n, n)
    return raster.Raster(grid.centres(grid.dense(spark)).select("row", "col", f.alias("value")), grid, "EPSG:32631")


def test_terrain_derivatives_and_geotiff(spark, tmp_path):
    slope = plane(spark, F.col("x") * 1.0)
    rows = raster.slope_aspect(slope).collect()
    assert all(r.slope == pytest.approx(45) for r in rows)
    flat = plane(spark, F.lit(3.0))
    assert all(r.shade == pytest.approx(255 * np.cos(np.radians(45))) for r in raster.hillshade(flat).collect())
    pit = plane(spark, F.when((F.col("row") == 5) & (F.col("col") == 6), -4.0).otherwise(0.0))
    assert [(r.row, r.col) for r in raster.sinkholes(pit).collect()] == [(5, 6)]
    assert raster.flood_mask(slope, 25).where("flooded").count() >= 36
    raster.export_geotiff(slope, str(tmp_path / "a.tif"))
    data = (tmp_path / "a.tif").read_bytes()
    assert data[:4] == b"II*\0" and np.frombuffer(data[-12 * 12 * 8 :], "<f8").reshape(12, 12)[0, 1] == 3.0
    with pytest.raises(ExportError):
        raster.export_geotiff(slope, str(tmp_path / "none" / "a.tif"))


def test_ground_filters(spark):
    c, p, high = terrain(spark)
    bare = PointFrame(c.df.drop("classification"), c.meta)
    for found in (ground.classify_ground_csf(bare, 2.0, iterations=200), ground.classify_ground_pmf(bare, 1.0, max_window_size=5)):
        got = found.df.orderBy("pid").toPandas().classification.to_numpy()
        assert (got[~high] == 2).mean() > 0.95 and (got[high] == 1).mean() > 0.9
    with pytest.raises(SegmentationError):
        ground.classify_ground_csf(from_arrays(spark, [[0, 0, 0]]))


def test_trees(spark):
    rng = np.random.default_rng(1)
    base = np.column_stack([rng.random((600, 2)) * 30, np.zeros(600)])
    crowns = [np.column_stack([c + rng.normal(size=(150, 2)), np.zeros(150)]) for c in ([7, 7], [22, 20])]
    for k, (crown, c) in enumerate(zip(crowns, ([7, 7], [22, 20]), strict=True)):
        crown[:, 2] = np.maximum(4.5, 10 + k - ((crown[:, :2] - c) ** 2).sum(1))
    c = from_arrays(spark, np.vstack([base, *crowns]), Acquisition(platform="aerial"))
    labels = cluster.segment_trees(c, 1.0, 4.0, 9.0).toPandas().set_index("pid").sort_index().label
    assert set(labels.loc[:599]) == {-1} and labels.max() >= 1
    top = [labels.loc[600:749].mode()[0], labels.loc[750:].mode()[0]]
    assert top[0] != top[1] and -1 not in [labels.loc[600:749][labels.loc[600:749] >= 0].mode()[0]]
    with pytest.raises(PlatformError):
        cluster.segment_trees(PointFrame(c.df, Acquisition(platform="terrestrial")))


def test_volumes(spark):
    rng = np.random.default_rng(0)
    xy = rng.random((2000, 2)) * 10
    low, high = (from_arrays(spark, np.column_stack([xy, np.full(2000, z)])) for z in (0.0, 2.0))
    v = change.compute_volume(high, low, 1.0).first()
    assert v.cut == pytest.approx(2 * v.area) and v.fill == 0 and v.net == v.cut
    assert change.compute_volume(low, low, 1.0).first().net == 0
    assert change.compute_volume(high, 0.5, 1.0).first().cut == pytest.approx(1.5 * v.area)
    with pytest.raises(ValidationError):
        change.compute_volume(high, low, 0)


def test_profiles(spark):
    rng = np.random.default_rng(0)
    p = np.column_stack([rng.random(4000) * 100, rng.random(4000) * 10 - 5])
    c = from_arrays(spark, np.column_stack([p, np.sin(p[:, 0] / 10)]))
    s = change.extract_cross_section(c, [(0, 0), (100, 0)], 2.0, 1.0).orderBy("bin").toPandas()
    assert np.abs(s.elevation - np.sin(s.station / 10)).max() < 0.1 and s.station.is_monotonic_increasing
    narrow = change.extract_cross_section(c, [(0, 0), (100, 0)], 0.5, 1.0).agg(F.sum("n")).first()[0]
    assert narrow < s.n.sum()
    profiles = change.extract_profiles(c, [(0, 0), (100, 0)], 25.0, 3.0, 1.0)
    assert {r.profile_id for r in profiles.collect()} == {0, 1, 2, 3, 4}
    assert change.extract_cross_section(c, [(0, 900), (1, 900)], 1.0).count() == 0
    with pytest.raises(ValidationError):
        change.extract_cross_section(c, [(0, 0)])


def test_corner_of_a_polyline_matches_brute_force(spark):
    p = np.random.default_rng(4).random((500, 2)) * 20
    c = from_arrays(spark, np.column_stack([p, np.arange(500.0)]))
    line = np.array([(1, 1), (15, 2), (14, 18)], float)
    got = {r.pid: r.station for r in change._stationed(c.df, spark.createDataFrame(change.polyline_segments(line), change._SEGMENT), 2.0).collect()}
    want, first = {}, 0.0
    for a, b in zip(line, line[1:], strict=False):
        t = np.clip(((p - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1)
        d = np.linalg.norm(p - a - t[:, None] * (b - a), axis=1)
        for k in range(500):
            if d[k] <= 2 and (k not in want or d[k] < want[k][0]):
                want[k] = (d[k], first + t[k] * np.linalg.norm(b - a))
        first += np.linalg.norm(b - a)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k][1]) for k in got)


def test_m3c2(spark):
    rng = np.random.default_rng(3)
    a, b = (np.column_stack([rng.random((900, 2)) * 10, np.full(900, z) + rng.normal(size=900) * 0.01]) for z in (0, 0.5))
    one, two = from_arrays(spark, a), from_arrays(spark, b)
    core = from_arrays(spark, [[3, 3, 0], [5, 5, 0], [7, 4, 0], [99, 99, 0]]).df
    rows = {r.pid: r for r in change.m3c2(one, two, core, 2.0, 1.0, 2.0).collect()}
    assert all(rows[k].distance == pytest.approx(0.5, abs=0.05) and rows[k].significant for k in range(3))
    assert rows[3].distance is None and not rows[3].significant
    sure, unsure = (change.m3c2(one, two, core, 2.0, 1.0, 2.0, registration_error=e).agg(F.max("lod")).first()[0] for e in (0.0, 0.3))
    assert unsure > sure
    near = (np.hypot(b[:, 0] - 5, b[:, 1] - 5) <= 0.99).sum()
    assert abs(rows[1].n2 - near) <= 3
    with pytest.raises(ChangeError):
        change.m3c2(one, two, confidence=1)


def test_balls_and_cylinders_match_brute_force():
    from terracell.plans.columns import Columns

    rng = np.random.default_rng(6)
    flat = rng.integers(0, 800, (5000, 2)) / 100  # so that many points lie on a ball's bound
    p = np.column_stack([flat, np.where(rng.random(5000) < 0.6, 1.0, rng.random(5000) * 9)])
    p[:40] = p[40]
    q = np.vstack([p[rng.choice(5000, 300)], rng.random((40, 3)) * 14 - 3])
    v = rng.normal(size=(340, 3)) + np.where(np.arange(340)[:, None] % 2 == 0, [0.0, 0.0, 50.0], 0.0)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found = Columns(p, np.arange(5000))
    d = p[None] - q[:, None]
    d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    inside, got = d2 <= 4.0, found.balls(q, 2.0)
    assert (inside.sum(1) == got[:, 0]).all() and got[:, 0].max() > 500 and got[:, 0].min() == 0
    assert np.allclose((d * inside[..., None]).sum(1), got[:, 1:4], atol=1e-8)
    for k, (a, b) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
        assert np.allclose((d[..., a] * d[..., b] * inside).sum(1), got[:, 4 + k], atol=1e-7)
    along = np.einsum("ijk,ik->ij", d, v)
    inside = (abs(along) <= 3.0) & (d2 - along * along <= 1.0)
    got = found.cylinders(q, v, 1.0, 3.0)
    assert np.allclose(np.column_stack([(w * inside).sum(1) for w in (inside, along, along * along)]), got, atol=1e-7)


def test_m3c2_of_many_points_in_one_place(spark):
    rng = np.random.default_rng(2)
    p = np.column_stack([rng.random((20_000, 2)), rng.normal(size=20_000) * 0.001])  # 4 x 10^8 pairs for the normals alone
    out = change.m3c2(from_arrays(spark, p), from_arrays(spark, p + [0, 0, 0.25]), None, 2.0, 2.0, 3.0).toPandas()
    assert len(out) == 20_000 and (out.n1 == 20_000).all() and (out.n2 == 20_000).all() and out.significant.all()
    assert np.allclose(out.distance, 0.25, atol=1e-4) and np.allclose(out.nz, 1, atol=1e-4)
    same = change.m3c2(from_arrays(spark, p[:9]), from_arrays(spark, p[:9]), None, 2.0, 1e-3, 3.0).toPandas()
    assert (same.n1 == 1).all() and not same.significant.any()  # a single point, twice


def test_tiles_lose_nothing(spark, tmp_path):
    p = np.array([[x, y, 0] for x in range(11) for y in range(11)], float)
    c = from_arrays(spark, p)
    t = tiling.tile_table(c, 5.0)
    assert t.count() == 4 and t.agg(F.sum("point_count")).first()[0] == 121
    assert tiling.tile_table(c, 5.0, drop_far_edge=True).agg(F.sum("point_count")).first()[0] == 100
    assert tiling.tile_table(c, 5.0, 1.0).agg(F.sum("point_count")).first()[0] > 121
    tiling.write_tiles(c, str(tmp_path / "t"), 5.0)
    inside = formats.read_tiled(spark, str(tmp_path / "t"), (2, 2, 7, 7), 5.0, (0, 0))
    assert inside.df.count() == 36
    assert "tile_col" in inside.df._jdf.queryExecution().executedPlan().toString()
    assert formats.tiled_metadata(spark, str(tmp_path / "t")).first().n_points == 121
    assert formats.read_tiled(spark, str(tmp_path / "t"), max_points=10).df.count() == 10


def test_web_exports(spark, tmp_path):
    rng = np.random.default_rng(1)
    p = rng.random((1000, 3)) * [8, 4, 2]
    c = from_arrays(spark, p)
    export.export_3dtiles(c, str(tmp_path / "a"), 300)
    index = json.loads((tmp_path / "a" / "tileset.json").read_text())
    sizes = []
    for child in index["root"]["children"]:
        data = (tmp_path / "a" / child["content"]["uri"]).read_bytes()
        _, _, total, text, _, _, _ = struct.unpack("<4s6I", data[:28])
        head = json.loads(data[28 : 28 + text])
        sizes.append(head["POINTS_LENGTH"])
        assert total == len(data) and (28 + text) % 8 == 0
    first = np.frombuffer(data[28 + text :][: 12 * sizes[-1]], "<f4").reshape(-1, 3) + head["RTC_CENTER"]
    assert sizes == [300, 300, 300, 100] and np.abs(first - p[900:]).max() < 1e-5
    export.export_potree(c, str(tmp_path / "b"), 6, 100)
    meta = json.loads((tmp_path / "b" / "metadata.json").read_text())
    assert meta["points"] == 1000 == sum((tmp_path / "b" / f"{n['name']}.bin").stat().st_size // 12 for n in meta["nodes"])
    assert max(n["points"] for n in meta["nodes"]) <= 100
    assert export.octree(c, 6, 100, drop_far_faces=True).count() < 1000
    with pytest.raises(ExportError):
        export.export_potree(c.filter("x < -1"), str(tmp_path / "c"))


def test_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    p = rng.random((200, 3)) * 100
    c = from_arrays(spark, p, Acquisition(crs="WKT", scanner_model="S"), intensity=rng.random(200), classification=np.full(200, 2, "u1"), red=np.arange(200).astype("u1"), green=np.zeros(200, "u1"), blue=np.full(200, 255, "u1"))
    for suffix, columns in (("las", ["intensity", "classification", "red", "blue"]), ("ply", ["red", "green", "blue"]), ("xyz", ["intensity"]), ("csv", ["intensity"]), ("parquet", ["classification"])):
        path = str(tmp_path / f"a.{suffix}")
        formats.write(c, path)
        back = formats.read(spark, path, "AERIAL")
        got = back.df.orderBy("pid").toPandas()
        assert np.abs(got[["x", "y", "z"]].to_numpy() - p).max() < 1e-3 and set(columns) <= set(got)
        assert back.meta.platform == "aerial"
        if suffix == "las":
            assert back.meta.crs == "WKT" and back.meta.scanner_model == "S" and got.red.tolist() == list(range(200)) and set(got.classification) == {2}
    assert formats.read(spark, str(tmp_path / "a.xyz"), subsample=0.1).df.count() == 20
    head = "VERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary\n"
    (tmp_path / "b.pcd").write_bytes(head.encode() + struct.pack("<3fI3fI", 1, 2, 3, 0x010203, 4, 5, 6, 0))
    got = formats.read(spark, str(tmp_path / "b.pcd")).df.orderBy("pid").first()
    assert (got.x, got.red, got.green, got.blue) == (1.0, 1, 2, 3)
    (tmp_path / "c.txt").write_text("# head\n1, 2, 3\n\n4,5,6 # tail\n")
    assert formats.read(spark, str(tmp_path / "c.txt")).df.count() == 2
    (tmp_path / "d.xyz").write_text("1 2\n")
    for error, f in ((StorageError, lambda: formats.read(spark, str(tmp_path / "no.las"))), (ValidationError, lambda: formats.read(spark, str(tmp_path / "a.xyz"), subsample=0)), (StorageError, lambda: formats.read(spark, str(tmp_path / "d.xyz"))), (ValidationError, lambda: formats.write(c, str(tmp_path / "x.pcd"))), (CodecError, lambda: formats.write(c, str(tmp_path / "x.laz")))):
        with pytest.raises(error):
            f()
    (tmp_path / "e.doc").write_text("")
    with pytest.raises(ValidationError):
        formats.read(spark, str(tmp_path / "e.doc"))


def test_projections(spark):
    p = from_arrays(spark, [[9.0, 48.0, 7.0], [3.0, -33.0, 8.0]])
    utm = crs.transform_coordinates(p.df.where("pid = 0"), "EPSG:4326", "EPSG:32632").first()
    assert (utm.x, utm.y, utm.z) == (pytest.approx(500_000, abs=1e-6), pytest.approx(5_316_300.2, abs=5), 7.0)
    for code in ("EPSG:32632", "EPSG:32732", "EPSG:3857"):
        there = crs.reproject(PointFrame(p.df, Acquisition(crs="EPSG:4326")), code)
        back = crs.reproject(there, "EPSG:4326").df.orderBy("pid").collect()
        assert all((r.x, r.y) == (pytest.approx(x, abs=1e-8), pytest.approx(y, abs=1e-8)) for r, (x, y) in zip(back, ((9, 48), (3, -33)), strict=True))
        assert there.meta.crs == code
    for bad in (lambda: crs.reproject(p, "EPSG:3857"), lambda: crs.transform_coordinates(p.df, "EPSG:4326", "nonsense")):
        with pytest.raises(TerracellError):
            bad()


def test_colours_models_meshes(spark, tmp_path):
    c, p, _ = terrain(spark, 100)
    image = np.zeros((20, 20, 3), "u1")
    image[..., 0] = 200
    got = colour.colorize_from_array(c, image, (1, 0, 0, 0, 1, 0), (1, 2, 3)).df
    assert {r.red for r in got.collect()} == {200} and "classification" in got.columns
    labels = spark.createDataFrame([(1, -1), (2, 0), (3, 1), (4, 2)], "pid long, label int")
    for r in colour.segment_colors(labels).collect():
        want = [int(np.floor(v * 255 + 1e-9)) for v in colour.segment_color(r.label, 3)]
        assert [r.red, r.green, r.blue] == want
    assert len(colour.view([c], 10)[0]) == 10
    with pytest.raises(ValueError):
        colour.view([])
    rows = model.prepare_features(c).collect()
    assert max(np.linalg.norm(r.features[:3]) for r in rows) == pytest.approx(1, abs=1e-6)
    out = model.predict_with(model.prepare_features(c, normalize=False), lambda: lambda x: np.stack([x[:, 2], 1 - x[:, 2]], 1), 7).toPandas()
    assert len(out) == 100 and set(out.label) == {0, 1} and set(out.class_name) <= set(model.CLASS_NAMES)
    for bad in (lambda: model.predict_semantic(c, "none.onnx"), lambda: model.predict_semantic(c, "none", "other")):
        with pytest.raises(ModelError):
            bad()
    m = mesh.grid_mesh(plane(spark, F.lit(1.0), 5))
    assert m.vertices.count() == 25 and m.faces.count() == 32
    assert mesh.alpha_shape_mesh(from_arrays(spark, [[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0], [50, 50, 0]]), 2.0).faces.count() == 2
    with pytest.raises(ValidationError):
        mesh.poisson_mesh(c)


def test_hidden_points(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 3))
    ball = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = from_arrays(spark, ball, Acquisition(scan_positions=(ScanPosition(0, 0, 20),)))
    seen = mesh.viewpoint_mask(c).toPandas().set_index("pid").visible
    assert seen[np.flatnonzero(ball[:, 2] > 0.3)].mean() > 0.8 and seen[np.flatnonzero(ball[:, 2] < -0.3)].mean() < 0.1
    with pytest.raises(ValidationError):
        mesh.viewpoint_mask(c, 1)


def test_hidden_points_part_by_part(spark, monkeypatch):
    rng = np.random.default_rng(4)
    p = np.column_stack([rng.random((6000, 2)) * 40 - 20, rng.random(6000) ** 3 * 5])
    p[17], p[4000] = p[5000], p[5000]
    monkeypatch.setattr(mesh, "PART_POINTS", 300)
    # From within the cloud, so that there are points all around, and from above.
    for at in ((0.0, 0.0, 2.5), (3.0, -2.0, 40.0)):
        given = p - at
        d = np.linalg.norm(given, axis=1)
        flipped = given * ((200 * d.max() - d) / d)[:, None]
        want = np.zeros(len(p) + 1, bool)
        want[mesh.hull_vertices(np.vstack([flipped, np.zeros(3)]))] = True
        c = from_arrays(spark, p, Acquisition(scan_positions=(ScanPosition(*at),)))
        seen = mesh.viewpoint_mask(c).toPandas().sort_values("pid").visible.to_numpy()
        assert len(seen) == len(p) and 100 < seen.sum() < len(p) and (seen == want[:-1]).all()
    # A hull of very many points, all of them vertices.
    ball = rng.normal(size=(20_000, 3))
    assert len(mesh.hull_vertices(ball / np.linalg.norm(ball, axis=1, keepdims=True))) == 20_000


def test_planes_and_cylinders(spark):
    rng = np.random.default_rng(0)
    a, b = (np.column_stack([rng.random((300, 2)) * 10, np.full(300, z) + rng.normal(size=300) * 0.003]) for z in (0, 5))
    found = primitives.detect_planes(from_arrays(spark, np.vstack([a, b])), 0.02, num_iterations=200, max_planes=3)
    assert len(found) == 2 and all(abs(abs(p.normal[2]) - 1) < 1e-3 and p.n_inliers >= 295 for p in found)
    t = rng.random(500) * 2 * np.pi
    tube = np.column_stack([3 + 0.5 * np.cos(t), 4 + 0.5 * np.sin(t), rng.random(500) * 5])
    c = from_arrays(spark, tube, nx=np.cos(t), ny=np.sin(t), nz=np.zeros(500))
    cyl = primitives.detect_cylinders(c, 0.02, (0.1, 1), 200)[0]
    assert cyl.radius == pytest.approx(0.5, abs=0.01) and cyl.n_inliers >= 490 and abs(cyl.axis[2]) == pytest.approx(1, abs=1e-3)
    with pytest.raises(ValidationError):
        primitives.detect_cylinders(c, radius_range=(2, 1))


def test_powerlines(spark):
    rng = np.random.default_rng(4)
    base = np.column_stack([rng.random((400, 2)) * [100, 20], np.zeros(400)])
    x = np.linspace(10, 90, 300)
    wire = np.column_stack([x, np.full(300, 10.0), 12 + 150 * np.cosh((x - 50) / 150) - 150])
    pylons = np.vstack([np.column_stack([px + rng.normal(size=300) * 0.02, 8 + rng.random(300) * 4, 3.2 + rng.random(300) * 17]) for px in (5.0, 95.0)])
    p = np.vstack([base, wire, pylons])
    cls = np.array([2] * 400 + [1] * 900, "u1")
    found = powerlines.detect_powerlines(from_arrays(spark, p, classification=cls), strict=True, min_clearance=13.0)
    pts = found.points.toPandas().set_index("pid").sort_index()
    assert pts.wire.loc[400:699].mean() > 0.8 and not (pts.wire & pts.pylon).any() and pts.violation.any()
    assert pts.hag.loc[400:699].min() == pytest.approx(12, abs=0.1)
    seg = found.segments.toPandas()
    assert len(seg) == 1 and seg.rmse[0] < 0.5
    a, x0, z0, rmse = powerlines.fit_catenary(x, 30 * np.cosh((x - 45) / 30) - 10)
    assert (a, x0, z0) == (pytest.approx(30, abs=1e-3), pytest.approx(45, abs=1e-3), pytest.approx(-10, abs=1e-2)) and rmse < 1e-4
    with pytest.raises(SegmentationError):
        powerlines.detect_powerlines(from_arrays(spark, p))


def test_streams(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("pid"), (F.col("id") % 10 * 1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"), F.timestamp_seconds("id").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.stream_tiles(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 5.0, availableNow=True).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.where("tile_col = 1").count() == 50
    q = ingest.stream_density(stream, 5.0).writeStream.format("memory").queryName("density").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(count) from density").first()[0] == 100


def test_command_line(spark, tmp_path, capsys):
    c, _, _ = terrain(spark, 100)
    source = str(tmp_path / "a.xyz")
    formats.write(c, source)
    assert main(["info", source]) == 0 and json.loads(capsys.readouterr().out)["n_points"] == 100
    assert main(["filter", source, "-o", str(tmp_path / "b.xyz"), "--voxel-size", "5"]) == 0
    assert main(["classify", source, "-o", str(tmp_path / "c.las"), "--algorithm", "pmf"]) == 0
    assert main(["convert", source, "-o", str(tmp_path / "d.ply")]) == 0
    assert main(["dem", source, "-o", str(tmp_path / "e.npy"), "--resolution", "5"]) == 0
    assert main(["tile", source, "-o", str(tmp_path / "f"), "--tile-size", "10"]) == 0
    assert main(["register", source, source, "-o", str(tmp_path / "g.xyz")]) == 0
    assert main(["info", str(tmp_path / "none.xyz")]) == 1 and main([]) == 2


def test_frames(spark):
    c, _, _ = terrain(spark, 50)
    assert c.ground_points().df.count() == 33 and platform_of("Nonsense") == "unknown"
    for bad in (lambda: PointFrame(c.df.drop("pid")), lambda: c.first_returns(), lambda: from_arrays(spark, [[1, 2]]), lambda: from_arrays(spark, [[1, 2, 3]], intensity=[1, 2])):
        with pytest.raises(ValidationError):
            bad()
    assert c.filter("x < -1").bounds is None and filters.crop(c, (0, 0, 0, 1, 1, 1)).meta == c.meta
