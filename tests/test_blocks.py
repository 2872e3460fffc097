"""Stencils on blocks against whole arrays, and consecutive numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators import cluster, ground
from terracell.plans.blocks import sweep, to_blocks, to_cells
from terracell.plans.grid import GridSpec
from terracell.plans.numbering import numbered


def cells_of(spark, a, name):
    return spark.createDataFrame([(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(a)], f"row long, col long, {name} double")


def array_of(df, name, shape, missing=np.nan):
    out = np.full(shape, missing)
    for r in df.collect():
        out[r.row, r.col] = r[name]
    return out


def plain_cloth(surface, keep, iterations):
    """Node by node."""
    ny, nx = surface.shape
    cloth = surface.copy()
    for _ in range(iterations):
        pulled = cloth + 0.1 * (surface - cloth)
        new = cloth.copy()
        for r in range(ny):
            for c in range(nx):
                mean = (pulled[max(r - 1, 0), c] + pulled[min(r + 1, ny - 1), c] + pulled[r, max(c - 1, 0)] + pulled[r, min(c + 1, nx - 1)]) / 4
                new[r, c] = max(surface[r, c], pulled[r, c] + (mean - pulled[r, c]) * (1 - keep))
        moved, cloth = np.abs(new - cloth).max(), new
        if moved < 1e-4:
            break
    return cloth


@pytest.mark.parametrize(("side", "steps", "iterations"), [(7, 5, 23), (64, 64, 300), (9, 9, 400)])
def test_cloth_by_blocks_is_the_whole_cloth(spark, monkeypatch, side, steps, iterations):
    monkeypatch.setattr(ground, "STEPS", steps)
    rng = np.random.default_rng(side)
    surface = rng.random((19, 31)) * 4 + np.linspace(0, 3, 31)
    grid = GridSpec(0, 0, 1.0, 31, 19)
    blocks = to_blocks(cells_of(spark, surface, "surface"), grid, {"surface": 0.0}, side)
    got = array_of(to_cells(ground.lay_cloth(blocks, grid, 3, iterations, side), grid, ["cloth"], side), "cloth", surface.shape)
    assert np.abs(got - plain_cloth(surface, 0.3, iterations)).max() < 1e-9


def test_halos_bring_what_lies_around(spark):
    a = np.arange(23 * 17, dtype=float).reshape(23, 17)
    grid = GridSpec(0, 0, 1.0, 17, 23)
    blocks = to_blocks(cells_of(spark, a, "v").where("col <> 3"), grid, {"v": -1.0}, 6)
    a[:, 3] = -1

    def total(arrays, core, corner):
        p = np.pad(arrays["v"], 2)
        n = arrays["v"].shape
        s = sum(p[i : i + n[0], j : j + n[1]] for i in range(5) for j in range(5))
        return {"s": s[core]}

    got = array_of(to_cells(sweep(blocks, grid, ["v"], 2, total, ["s"], side=6), grid, ["s"], 6), "s", a.shape)
    p = np.pad(a, 2)
    assert np.array_equal(got, sum(p[i : i + 23, j : j + 17] for i in range(5) for j in range(5)))


def plain_watershed(depth, markers):
    """Recompute every cell from its neighbours until nothing changes."""
    ny, nx = depth.shape
    state = {(r, c): (depth[r, c], 0, m) for (r, c), m in markers.items()}
    while True:
        new = {}
        for r in range(ny):
            for c in range(nx):
                if (r, c) in markers:
                    new[r, c] = (depth[r, c], 0, markers[r, c])
                    continue
                offers = []
                for q in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if q in state:
                        at, n, of = state[q]
                        offers.append((depth[r, c], 1, of) if depth[r, c] > at else (at, n + 1, of))
                if offers:
                    new[r, c] = min(offers)
        if new == state:
            return state
        state = new


@pytest.mark.parametrize("side", [5, 64])
def test_watershed_by_blocks_is_the_whole_watershed(spark, side):
    rng = np.random.default_rng(4)
    depth = rng.integers(0, 6, (17, 22)).astype(float)  # plateaus and ties
    markers = {(1, 1): 0, (8, 12): 1, (16, 21): 2, (3, 19): 3, (8, 13): 1}
    grid = GridSpec(0, 0, 1.0, 22, 17)
    given = spark.createDataFrame([(r, c, float(m)) for (r, c), m in markers.items()], "row long, col long, crown double")
    got = array_of(cluster.watershed(cells_of(spark, depth, "depth"), given, grid, side), "crown", depth.shape, -1)
    want = plain_watershed(depth, markers)
    assert {k: got[k] for k in want} == {k: float(v[2]) for k, v in want.items()}
    assert len(want) == depth.size


def test_numbers_are_consecutive(spark):
    rows = spark.range(0, 5000, 3).select((F.col("id") * 7919 % 10007).alias("k"))
    got = numbered(rows.repartition(13), "k", "n", 5).toPandas().sort_values("k")
    assert got.n.tolist() == list(range(5, 5 + len(got)))
    assert numbered(rows.limit(0), "k", "n").count() == 0


def test_derived_products(spark):
    from terracell.frame import Acquisition
    from terracell.sources.formats import from_arrays

    rng = np.random.default_rng(2)
    flat = np.column_stack([rng.random((4000, 2)) * 60, np.zeros(4000)])
    roof = np.column_stack([rng.random((3000, 2)) * [12, 8] + [10, 20], np.full(3000, 6.0)])
    shed = np.column_stack([rng.random((400, 2)) * [3, 3] + [40, 40], np.full(400, 4.0)])
    cloud = from_arrays(spark, np.vstack([flat, roof, shed]), Acquisition(platform="aerial"))
    found = cluster.building_footprints(cloud, 1.0, 2.5, 20.0).collect()
    assert len(found) == 1 and found[0].height == pytest.approx(6.0) and 90 <= found[0].area <= 130
    labels = cluster.segment_trees(cloud, 1.0, 2.0, 4.0)
    trees = cluster.tree_table(cloud, labels).collect()
    row = cluster.stems_per_hectare(cloud, labels).first()
    assert row.stems == len(trees) and row.top_height == pytest.approx(6.0) and row.per_hectare == pytest.approx(row.stems / row.hectares)


def test_exact_percentiles(spark):
    from terracell.operators.metrics import exact_percentiles

    rng = np.random.default_rng(3)
    for values in (rng.normal(size=3001), np.repeat([1.0, 2.0], 900), rng.integers(0, 9, 2500).astype(float), np.array([4.0]), np.concatenate([rng.random(2000) * 1e-9, [1e12, -1e12]])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = exact_percentiles(df, "v", [0.05, 0.25, 0.5, 0.95, 1.0], gathered=50)
        assert got == pytest.approx(np.quantile(values, [0.05, 0.25, 0.5, 0.95, 1.0]).tolist(), rel=1e-12, abs=1e-15)
    assert exact_percentiles(df.limit(0), "v", [0.5]) == [None]
